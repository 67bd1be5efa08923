"""Registered jobs reach every row of their tables."""

import cueloom.plans.more_queries  # noqa: F401
import cueloom.plans.state_queries  # noqa: F401
from cueloom.plans.queries import QUERIES
from cueloom.sources import adapters

from .conftest import SMALL


def test_ladder_replies_to_every_cue(spark):
    cues = {(r.media, r.cue_idx): r.text for r in adapters.cues(spark, SMALL).collect()}
    assert any("ß" in t for t in cues.values())
    got = QUERIES["model_ladder"](spark, SMALL).collect()
    assert len(got) == len(cues) and {(r.media, r.cue_idx): r.reply for r in got} == {k: f"r:{t}" for k, t in cues.items()}


def test_batch_and_upsert_take_all_tasks(spark):
    tasks = adapters.tasks(spark, SMALL).collect()
    done = {(t.video_sha, t.kind) for t in tasks if t.status == "completed"}
    want = {m: ",".join(k for k in ("insight", "transcribe", "translate") if (m, k) not in done) for m in {t.video_sha for t in tasks}}
    assert {r.sha256: r.steps for r in QUERIES["batch_creation"](spark, SMALL).collect()} == {m: s for m, s in want.items() if s}
    got = {r.id: r.status for r in QUERIES["upsert_merge"](spark, SMALL).collect()}
    assert {t.id for t in tasks} == {i for i in got if i >= 0} and min(got) < 0
    assert all(got[t.id] == ("queued" if t.status == "failed" else t.status) for t in tasks)


def test_points_reach_the_end_of_each_timeline(spark):
    last: dict = {}
    for c in adapters.cues(spark, SMALL).collect():
        last[c.media] = max(last.get(c.media, 0), c.end_ms)
    want = {(m, i) for m, e in last.items() for i in range(e // 7777 + 1)}
    assert max(last.values()) > 12 * 7777
    assert {(r.media, r.pos) for r in QUERIES["active_cue"](spark, SMALL).collect()} == want
    assert {(r.media, r.pos) for r in QUERIES["nearest_source"](spark, SMALL).collect()} == want
