"""Fixed values of the domain: text patterns and rule tables that results depend on."""

from __future__ import annotations

from tracefold.functions.text import TextRule

# Narration patterns in order of precedence, the first whole match wins; what each states beside the
# values of its groups, whose names a phrase holds, and what some groups stand for.
_TRIGGER = ("TRIGGER_NOTIFICATION",)
_ACTOR, _TARGET, _NAMED = {"actor": "subject"}, {"target": "subject"}, {"target": "target"}
_ENDS = {"消失": "end", "結束": "end", "恢復原狀": "end", "": "start"}
NARRATION = [
    TextRule("move.used", "MOVE", "(?P<subject>.+?)使出了(?P<move>.+?)[!]", 0.99, (), {"action": "use"}, _ACTOR),
    TextRule("item.activated", "ITEM", "(?P<subject>.+?)使用了(?P<item>.+?)[!]", 0.99, _TRIGGER, {"action": "activate"}, _ACTOR),
    TextRule("ability.activated", "ABILITY", "(?P<subject>.+?)的(?P<ability>[^!]+)[!]?", 0.94, _TRIGGER, {"action": "activate"}, _ACTOR),
    TextRule("switch.go", "SWITCH", "上吧!(?P<body>.+)!", 0.98, (), {"action": "switch_in"}, {"lines": "body"}),
    TextRule("switch.sent_out", "SWITCH", "(?P<trainer>.+?)派出了(?P<sent>.+?)[!]", 0.98, (), {"action": "switch_in"}, {"targets": "sent"}),
    TextRule("faint.fell", "FAINT", "(?P<subject>.+?)倒下了[!]", 0.99, (), {"action": "faint"}, _TARGET),
    TextRule("status.damage", "DAMAGE_RESULT", "(?P<subject>.+?)受到了(?P<status>灼傷|中毒|劇毒)的傷害[!]", 0.99, (), {"action": "damage", "cause": "status"}, _TARGET),
    TextRule("damage.recoil", "DAMAGE_RESULT", "(?P<subject>.+?)受到了反作用力造成的傷害[!]", 0.99, (), {"action": "damage", "cause": "recoil"}, _TARGET),
    TextRule("damage.hp_loss", "DAMAGE_RESULT", "(?P<subject>.+)的生命被削減了一些[!]", 0.93, (), {"action": "damage", "cause": "unspecified"}, _TARGET),
    TextRule("status.inflicted", "STATUS", "(?P<subject>.+?)被(?P<status>灼傷|中毒|劇毒|麻痺|睡眠|冰凍|混亂)了[!]", 0.99, (), {"action": "inflict"}, _TARGET),
    TextRule(
        "stat.changed", "STAT_CHANGE", "(?P<subjects>.+?)的(?P<stat>攻擊|防禦、特防|防禦|特攻|特防|速度|命中率|閃避率)(?P<change>大幅提高|提高|大幅降低|降低)了[!]", 0.98, (), {"action": "change"}, {"target": "subjects"},
        {"direction": ("change", {"大幅提高": "raise", "提高": "raise", "": "lower"}), "magnitude": ("change", {"大幅提高": "2", "大幅降低": "2", "": "1"})},
    ),
    TextRule("move_result.helping_hand", "MOVE_RESULT", "(?P<subject>.+?)擺出了幫助(?P<aided>.+?)的架勢[!]", 0.97, (), {"action": "prepare", "result": "helping_hand_ready"}, {"actor": "subject", "aided": "aided"}),
    TextRule("move_result.super_effective", "MOVE_RESULT", "對(?P<target>.+?)效果絕佳[!]", 0.99, (), {"action": "resolve", "result": "super_effective"}, _NAMED),
    TextRule("move_result.not_very_effective", "MOVE_RESULT", "對(?P<target>.+?)效果不太好[!]", 0.96, (), {"action": "resolve", "result": "not_very_effective"}, _NAMED),
    TextRule("move_result.miss", "MOVE_RESULT", "沒有擊中(?P<target>.+?)[!]", 0.99, (), {"action": "resolve", "result": "miss"}, _NAMED),
    TextRule("move_result.critical", "MOVE_RESULT", "擊中了要害[!]", 0.99, (), {"action": "resolve", "result": "critical_hit"}),
    TextRule("weather.started", "WEATHER", "開始下(?P<weather>雨|雪|冰雹)了[!]", 0.98, (), {"action": "start"}),
    TextRule("weather.ended", "WEATHER", "(?P<weather>雨|雪|冰雹|日照)停了[!]", 0.98, (), {"action": "end"}),
    TextRule("terrain.changed", "TERRAIN", "(?P<terrain>青草場地|電氣場地|精神場地|薄霧場地)(?P<verb>出現|展開|消失|結束|恢復原狀)了?[!]", 0.94, (), {}, {}, {"action": ("verb", _ENDS)}),
    TextRule("field.activated", "FIELD_EFFECT", "聽過(?P<effect>滅亡之歌)的.+?(?P<counter>[0-9]+)回合後就會滅亡[!]", 0.97, (), {"action": "activate"}),
    TextRule("side_condition.tailwind_started", "SIDE_CONDITION", "從(?P<whose>對手)?身後吹起了順風[!]", 0.98, (), {"action": "start", "effect": "順風"}, {}, {"side": ("whose", {"對手": "opponent", "": "player"})}),
    TextRule("side_condition.tailwind_ended", "SIDE_CONDITION", "(?P<whose>對手的)?順風停止了[!]", 0.98, (), {"action": "end", "effect": "順風"}, {}, {"side": ("whose", {"對手的": "opponent", "": "player"})}),
    TextRule("volatile.counter_updated", "VOLATILE_STATUS", "(?P<subject>.+?)的(?P<effect>滅亡計時)變成(?P<counter>[0-9]+)了?[!]", 0.98, (), {"action": "update"}, _TARGET),
    TextRule("volatile.effect_ended", "VOLATILE_STATUS", "(?P<subject>.+?)的(?P<ended>再來一次狀態|定身法)解除了[!]", 0.97, (), {"action": "end"}, _TARGET, {"effect": ("ended", {"再來一次狀態": "再來一次", "": "定身法"})}),
    TextRule("volatile.protect_started", "VOLATILE_STATUS", "(?P<subject>.+?)擺出了防守的架勢[!]", 0.97, (), {"action": "start", "effect": "守住"}, _TARGET),
    TextRule("volatile.encore_started", "VOLATILE_STATUS", "(?P<subject>.+?)接受了再來一次[!]", 0.97, (), {"action": "start", "effect": "再來一次"}, _TARGET),
    TextRule("move_result.protected", "MOVE_RESULT", "(?P<subject>.+?)在攻擊中守護住了自己[!]", 0.98, (), {"action": "block", "result": "protected", "effect": "守住"}, _TARGET),
    TextRule("volatile.move_disabled", "VOLATILE_STATUS", "封住了(?P<subject>.+)的(?P<move>.+?)[!]?", 0.97, (), {"action": "apply", "effect": "定身法"}, _TARGET),
    TextRule("move_result.prevented", "MOVE_RESULT", "(?P<subject>.+?)因(?P<effect>定身法)而無法使出(?P<move>.+?)[!]", 0.98, (), {"action": "resolve", "result": "prevented"}, _TARGET),
    TextRule("transformation.activated", "TRANSFORMATION", "(?P<subject>.+)的(?P<item>.+?進化石)和(?P<trainer>.+?)的(?P<device>.+?)產生了反應[!]", 0.96, (), {"action": "activate"}, _ACTOR),
    TextRule("transformation.completed", "TRANSFORMATION", "(?P<subject>.+?)超級進化成了(?P<form>.+?)[!]", 0.96, (), {"action": "change", "effect": "form_change"}, _ACTOR),
    TextRule("battle_result.forfeit", "BATTLE_RESULT", "有一方選擇了投降[。!]", 0.99, (), {"action": "end", "result": "forfeit"}),
    TextRule("battle_result.win", "BATTLE_RESULT", "成功戰勝了(?P<loser>.+?)[!]", 0.98, (), {"action": "end", "result": "win"}),
]

# Fields that a narration line may state once.
SINGLES = ("actor", "target", "side", "move", "ability", "item", "trainer", "status", "cause", "stat", "direction", "magnitude", "weather", "terrain", "effect", "counter", "form", "device", "result", "loser", "action")

# Least score per screen state, in order of precedence.
STATES = {"TEAM_PREVIEW": 0.84, "SELECTED_FOUR": 0.83, "MOVE_MENU": 0.80, "BATTLE_TEXT": 0.50, "TRIGGER_NOTIFICATION": 0.50, "RESULT": 0.84}

# Least number of samples of a candidate interval.
LEAST_SAMPLES = {"TEAM_PREVIEW": 3, "SELECTED_FOUR": 3, "MOVE_MENU": 3, "BATTLE_TEXT": 1, "TRIGGER_NOTIFICATION": 2, "RESULT": 3}

# Limits of the look-back, kinds that bar it, and the rules in order of precedence.
LOOK_BACK = 10.0
LEAST_GAP = -2.0
LINK_FROM = 0.85
BARRIERS = ("MOVE", "SWITCH", "TRANSFORMATION", "BATTLE_RESULT")
STANDALONE = BARRIERS + ("WEATHER", "TERRAIN", "FIELD_EFFECT", "SIDE_CONDITION", "ABILITY", "ITEM")
# rule, source kind, target kinds, most gap, required pairs, optional pairs, relation, base, barred, mode, source conditions, target conditions
RELATIONS = [
    ("transformation.same_actor_phase", "TRANSFORMATION", ("TRANSFORMATION",), 10.0, (("actor", "actor"),), (), "SAME_ACTION", 0.98, True, "link", (("action", "activate"),), (("action", "change"),)),
    ("switch.triggered_ability", "SWITCH", ("ABILITY",), 4.0, (("participants", "actor"),), (), "TRIGGERED_BY", 0.97, True, "link", (), ()),
    ("move.actor_result_actor", "MOVE", ("MOVE_RESULT",), 4.0, (("actor", "actor"),), (("move", "move"),), "RESULT_OF", 0.96, True, "link", (), ()),
    ("move.explicit_target_result", "MOVE", ("MOVE_RESULT",), 6.0, (("target", "target"),), (("move", "move"),), "RESULT_OF", 0.97, True, "link", (), ()),
    ("move.explicit_target_damage", "MOVE", ("DAMAGE_RESULT",), 6.0, (("target", "target"),), (), "DAMAGE_FROM", 0.97, True, "link", (), ()),
    ("move.explicit_target_status", "MOVE", ("STATUS",), 7.0, (("target", "target"),), (), "STATUS_FROM", 0.97, True, "link", (), ()),
    ("move.explicit_target_stat_change", "MOVE", ("STAT_CHANGE",), 6.0, (("target", "target"),), (), "STAT_CHANGE_FROM", 0.96, True, "link", (), ()),
    ("switch.same_target_stat_change", "SWITCH", ("STAT_CHANGE",), 4.0, (("participants", "target"),), (), "STAT_CHANGE_FROM", 0.94, True, "link", (), ()),
    ("move.effect_match", "MOVE", ("VOLATILE_STATUS", "SIDE_CONDITION", "FIELD_EFFECT"), 6.0, (("move", "effect"),), (), "STATUS_FROM", 0.96, True, "link", (), ()),
    ("move.self_stat_change", "MOVE", ("STAT_CHANGE",), 6.0, (("actor", "target"),), (), "STAT_CHANGE_FROM", 0.95, True, "link", (), ()),
    ("move.recoil_damage", "MOVE", ("DAMAGE_RESULT",), 6.0, (("actor", "target"),), (), "DAMAGE_FROM", 0.98, True, "link", (), (("cause", "recoil"),)),
    ("move.triggered_item", "MOVE", ("ITEM",), 4.0, (("actor", "actor"),), (), "TRIGGERED_BY", 0.94, True, "link", (), ()),
    ("item.damage_same_actor", "ITEM", ("DAMAGE_RESULT",), 2.0, (("actor", "target"),), (), "DAMAGE_FROM", 0.95, True, "link", (), ()),
    ("damage.faint_same_target", "DAMAGE_RESULT", ("FAINT",), 2.0, (("target", "target"),), (), "RESULT_OF", 0.98, True, "link", (), ()),
    ("move_result.faint_same_target", "MOVE_RESULT", ("FAINT",), 2.0, (("target", "target"),), (), "RESULT_OF", 0.96, True, "link", (), ()),
    ("damage.same_residual_batch", "DAMAGE_RESULT", ("DAMAGE_RESULT",), 0.8, (("cause", "cause"), ("action", "action")), (("status", "status"),), "SAME_ACTION", 0.97, False, "link", (), ()),
    ("volatile.same_counter_batch", "VOLATILE_STATUS", ("VOLATILE_STATUS",), 0.8, (("effect", "effect"), ("action", "action"), ("counter", "counter")), (), "SAME_ACTION", 0.98, False, "link", (("action", "update"),), (("action", "update"),)),
    ("battle_result.forfeit_then_win", "BATTLE_RESULT", ("BATTLE_RESULT",), 2.0, (), (), "FOLLOWED_BY", 0.96, True, "link", (("result", "forfeit"),), (("result", "win"),)),
    ("temporal.move_result", "MOVE", ("MOVE_RESULT",), 5.0, (), (("move", "move"), ("target", "target")), "TEMPORALLY_ADJACENT", 0.68, True, "review", (), ()),
    ("temporal.move_damage", "MOVE", ("DAMAGE_RESULT",), 6.0, (), (("target", "target"),), "TEMPORALLY_ADJACENT", 0.61, True, "review", (), ()),
    ("temporal.move_status", "MOVE", ("STATUS",), 7.0, (), (("target", "target"),), "TEMPORALLY_ADJACENT", 0.66, True, "review", (), ()),
    ("temporal.move_stat_change", "MOVE", ("STAT_CHANGE",), 5.0, (), (("target", "target"),), "TEMPORALLY_ADJACENT", 0.64, True, "review", (), ()),
    ("temporal.move_faint", "MOVE", ("FAINT",), 8.0, (), (("target", "target"),), "TEMPORALLY_ADJACENT", 0.58, True, "review", (), ()),
    ("temporal.move_weather", "MOVE", ("WEATHER",), 4.0, (), (), "TEMPORALLY_ADJACENT", 0.62, True, "review", (), ()),
    ("temporal.ability_stat_change", "ABILITY", ("STAT_CHANGE",), 2.0, (), (), "TEMPORALLY_ADJACENT", 0.65, True, "review", (), ()),
]
# Rules whose edges make a batch.
BATCH_RULES = ("damage.same_residual_batch", "volatile.same_counter_batch")

# The type of fact that an event states, by kind and action.
FACT_TYPES = {
    ("MOVE", "use"): "MOVE_USED",
    ("MOVE_RESULT", "block"): "MOVE_RESOLVED",
    ("MOVE_RESULT", "prepare"): "MOVE_RESOLVED",
    ("MOVE_RESULT", "resolve"): "MOVE_RESOLVED",
    ("DAMAGE_RESULT", "damage"): "DAMAGE_OBSERVED",
    ("SWITCH", "switch_in"): "SWITCH_IN",
    ("ABILITY", "activate"): "ABILITY_ACTIVATED",
    ("ITEM", "activate"): "ITEM_ACTIVATED",
    ("STATUS", "inflict"): "STATUS_APPLIED",
    ("STATUS", "remove"): "STATUS_REMOVED",
    ("STATUS", "change"): "STATUS_CHANGED",
    ("STAT_CHANGE", "change"): "STAT_CHANGED",
    ("WEATHER", "start"): "WEATHER_STARTED",
    ("WEATHER", "end"): "WEATHER_ENDED",
    ("WEATHER", "change"): "WEATHER_CHANGED",
    ("TERRAIN", "start"): "TERRAIN_STARTED",
    ("TERRAIN", "end"): "TERRAIN_ENDED",
    ("TERRAIN", "change"): "TERRAIN_CHANGED",
    ("FIELD_EFFECT", "activate"): "FIELD_EFFECT_STARTED",
    ("FIELD_EFFECT", "end"): "FIELD_EFFECT_ENDED",
    ("FIELD_EFFECT", "update"): "FIELD_EFFECT_UPDATED",
    ("SIDE_CONDITION", "start"): "SIDE_CONDITION_STARTED",
    ("SIDE_CONDITION", "end"): "SIDE_CONDITION_ENDED",
    ("SIDE_CONDITION", "update"): "SIDE_CONDITION_UPDATED",
    ("VOLATILE_STATUS", "apply"): "VOLATILE_STATUS_APPLIED",
    ("VOLATILE_STATUS", "start"): "VOLATILE_STATUS_APPLIED",
    ("VOLATILE_STATUS", "end"): "VOLATILE_STATUS_REMOVED",
    ("VOLATILE_STATUS", "update"): "VOLATILE_STATUS_UPDATED",
    ("TRANSFORMATION", "activate"): "TRANSFORMATION_OCCURRED",
    ("TRANSFORMATION", "change"): "TRANSFORMATION_OCCURRED",
    ("FAINT", "faint"): "KO",
    ("BATTLE_RESULT", "end"): "BATTLE_ENDED",
}

# Quality weights of a picture's preparation steps, in order.
VARIANT_WEIGHTS = (1.0, 0.95, 0.85, 0.8)

# Stats by their written names, bounds of a stage, and weights of what makes a state complete.
STATS = {"攻擊": "attack", "防禦": "defense", "特攻": "special_attack", "特防": "special_defense", "速度": "speed", "命中": "accuracy", "閃避": "evasion"}
STAGE_BOUNDS = (-6, 6)
COMPLETENESS = {"result": 0.10, "player_conditions": 0.08, "opponent_conditions": 0.08, "weather": 0.08, "core": 0.16}
# What an event must state before it changes anything, and factors of its confidence.
REQUIRED = {
    "FAINT": ("target",),
    "STATUS": ("status", "target"),
    "VOLATILE_STATUS": ("effect", "target"),
    "STAT_CHANGE": ("stat", "direction", "magnitude"),
    "WEATHER": ("weather",),
    "SIDE_CONDITION": ("effect", "side"),
    "FIELD_EFFECT": ("effect",),
    "TRANSFORMATION": ("actor",),
    "ABILITY": ("actor", "ability"),
    "ITEM": ("actor", "item"),
    "BATTLE_RESULT": ("result",),
    "MOVE": ("actor", "move"),
    "MOVE_RESULT": ("result",),
    "DAMAGE_RESULT": ("target",),
}
FACTORS = {"stated": 1.0, "adopted": 0.92, "no_side": 0.86, "unresolved": 0.65}
