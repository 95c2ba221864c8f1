import random

from tracefold.llm.canon_list import character_tokens, kept_share, map_to_list, pair_tokens, plain_name, similarity_join

NAMES = [(1, "霞舞穗鎖谷"), (1, "Wyndroru"), (2, "光歌"), (3, "斬衝電墨"), (3, "Xanquintortri"), (4, "狼帆歌芽"), (5, "狼璃歌芽")]


def found(spark, values, names=NAMES, kind="k"):
    ref = spark.createDataFrame([(kind, i, n, 0.0) for i, n in names], "block string, entry_id int, name string, kept double")
    df = spark.createDataFrame([(v, kind, 1) for v in values], "v string, kind string, entry_id int")
    return {r.value: r.entry_id for r in map_to_list(df, "v", "kind", ref).collect()}


def test_marks_misreadings_and_strangers(spark):
    got = found(
        spark,
        ["▶霞舞穗鎖谷 PP 9/15", "霞舞​穗　鎖谷", "紗衝電墨", "【斬衝電墨】", "Lv.67 光歌", "wyndoru", "xanquintor-tri", "狼璃歌芽", "狼帆歌", "玉蛾環纏", "NO DATA", "返回", "???", "", None, "2. 光歌", "光歌♀ Lv9"],
    )
    assert got == {
        "▶霞舞穗鎖谷 PP 9/15": 1, "霞舞​穗　鎖谷": 1, "紗衝電墨": 3, "【斬衝電墨】": 3, "Lv.67 光歌": 2, "wyndoru": 1, "xanquintor-tri": 3, "狼璃歌芽": 5,
        "狼帆歌": 4, "玉蛾環纏": None, "NO DATA": None, "返回": None, "???": None, "": None, None: None, "2. 光歌": 2, "光歌♀ Lv9": 2,
    }


def test_the_join_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("山川日月火水木金土人") for _ in range(rng.randrange(1, 8)))
    names, values = sorted({word() for _ in range(60)}), sorted({word() for _ in range(200)})
    frame = lambda words: spark.createDataFrame([("k", w, character_tokens(w)) for w in words], "block string, text string, tokens array<string>")
    for threshold in (0.34, 0.5, 0.8):
        want = set()
        for v in values:
            for n in names:
                a, b = set(character_tokens(v)), set(character_tokens(n))
                if len(a & b) / len(a | b) >= threshold - 1e-9:
                    want.add((v, n))
        for small in (True, False):
            got = similarity_join(frame(values), frame(names), threshold, small)
            assert {(r.value, r.name) for r in got.collect()} == want
        got = similarity_join(frame(values), frame(names), threshold, True, 0.6)
        of = {w: set(character_tokens(w)) for w in (*values, *names)}
        assert {(r.value, r.name) for r in got.collect()} == {(v, n) for v, n in want if len(of[v] & of[n]) >= 0.6 * len(of[n]) - 1e-9}


def test_blocks_empty_lists_and_long_values(spark):
    assert found(spark, ["光歌"], []) == {"光歌": None}
    assert found(spark, [], NAMES) == {}
    assert found(spark, ["光歌" * 100_000]) == {"光歌" * 100_000: None}
    df = spark.createDataFrame([("光歌", "other"), ("光歌", None)], "v string, kind string")
    ref = spark.createDataFrame([("k", 2, "光歌"), (None, 3, "光歌")], "block string, entry_id int, name string")
    assert [r.entry_id for r in map_to_list(df, "v", "kind", ref).collect()] == [None, None]


def test_ties_go_to_the_smaller_id(spark):
    assert found(spark, ["狼口歌芽"]) == {"狼口歌芽": 4}


def test_parts():
    assert plain_name(" Ｄｕｓｋｙ_Ｋｎｏｔ PP10") == "duskyknot"
    assert character_tokens("芽芽") == ["芽", "芽2"] and pair_tokens("aba") == ["^a", "ab", "ba", "a$"]
    assert character_tokens("aba") == [] and pair_tokens("芽芽") == [] and pair_tokens("a芽b") == ["^a", "ab", "b$"]
    assert kept_share("axbc", "abc") == 1 and kept_share("", "abc") == 0


def test_readings_of_both_scripts(spark):
    names = [*NAMES, (8, "Double Edge"), (9, "火Burst")]
    got = found(spark, ["Wyndroru人", "Wyn一droru", "光歌Z", "Double—Edge", "— Wyndroru", "Burst火", "火burs", "burst"], names)
    assert got == {"Wyndroru人": 1, "Wyn一droru": 1, "光歌Z": 2, "Double—Edge": 8, "— Wyndroru": 1, "Burst火": 9, "火burs": 9, "burst": 9}


def test_kept_share_equals_the_table():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd火") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
        assert kept_share(a, b) == (table[-1][-1] / len(b) if b else 0)
