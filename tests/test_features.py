from tracefold.plans import feature_queries


def test_snapshot_delta_reports_every_slot(spark, tmp_path):
    hp = [("o1", "r", "player", "left", 0.0, 90.0), ("o2", "r", "opponent", "right", 0.0, 80.0), ("o3", "r", "opponent", "right", 4.0, 30.0)]
    spark.createDataFrame(hp, "observation_id string, replay_id string, side string, slot string, timestamp double, hp_percent double").write.parquet(f"{tmp_path}/hp_observations.parquet")
    spark.createDataFrame([("g1", "r", 1.0, 2.0), ("g2", "r", 5.0, 6.0)], "timeline_id string, replay_id string, start_time double, end_time double").write.parquet(f"{tmp_path}/timeline_groups.parquet")
    got = {tuple(r) for r in feature_queries.snapshot_delta(spark, str(tmp_path)).collect()}
    assert got == {("g1", "player", "left", None, 90.0), ("g1", "opponent", "right", None, 80.0), ("g2", "opponent", "right", 80.0, 30.0)}


def test_evidence_is_asked_for_all_candidates_ticks_and_results(spark, tmp_path):
    score = lambda i: {"MOVE_MENU": 0.9 if i == 13 else 0.5, "RESULT": 0.1}
    frames = [("r", i, i / 10, " result" if i == 70 else "UNKNOWN", ["result"], score(i)) for i in range(1, 101) if i not in (50, 90)]
    spark.createDataFrame(frames, "replay_id string, sample_index int, pts double, ui_state string, visible_rois array<string>, candidate_scores map<string,double>").write.parquet(f"{tmp_path}/frame_scan.parquet")
    events = [("e1", "r", "MOVE_MENU", 1.15, 1.65, ["move_menu"]), ("e2", "r", "TEAM_PREVIEW", 8.98, 8.99, ["team_preview"]), ("e3", "r", "RESULT", 20.0, 21.0, ["result"])]
    spark.createDataFrame(events, "event_id string, replay_id string, type string, start_time double, end_time double, visible_rois array<string>").write.parquet(f"{tmp_path}/event_candidates.parquet")
    spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 10.0, 10.0)], "replay_id string, sample_index int, pts double, target_time double").write.parquet(f"{tmp_path}/sample_plan.parquet")
    got = {r.sample_index: r.rois for r in feature_queries.evidence_requests(spark, str(tmp_path)).collect()}
    assert got == {1: "battle_text", 12: "move_menu", 13: "move_menu", 16: "move_menu", 49: "battle_text", 70: "result", 89: "team_preview", 100: "battle_text|result"}
