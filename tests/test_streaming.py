from __future__ import annotations

import os

import pytest

from refract.streaming.arrivals import arriving_files, inspect_arrivals, judge_arrivals

from .test_media import FILES


def test_arrivals_are_seen_once(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        q = inspect_arrivals(arriving_files(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out/products")).select("product").collect()

    for name in ("a.png", "b.mp3"):
        (tmp_path / "in" / name).write_bytes(FILES[name])
    assert sorted(r["product"] for r in run()) == ["ComfyUI", "Stable Diffusion", "Suno"]
    (tmp_path / "in" / "c.wav").write_bytes(FILES["c.wav"])
    assert sorted(r["product"] for r in run()) == ["ComfyUI", "ElevenLabs", "Stable Diffusion", "Suno"]


@pytest.mark.parametrize("horizon", [None, "1 hour"])
def test_contents_are_judged_once(spark, tmp_path, horizon):
    """Copies under other names, in one batch, later and after restarts, give no second verdict; a replay gives the same table."""
    (tmp_path / "in").mkdir()

    def put(name, of):
        (tmp_path / "in" / name).write_bytes(FILES[of])

    def run():
        q = judge_arrivals(arriving_files(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "checkpoint"), horizon)
        q.awaitTermination(120)
        assert q.exception() is None
        rows = spark.read.parquet(str(tmp_path / "out")).select("path", "digest", "confidence", "batch").collect()
        return sorted((r.digest, r.confidence, r.batch, os.path.basename(r.path)) for r in rows)

    put("a.png", "a.png"), put("copy.png", "a.png"), put("b.mp3", "b.mp3")
    first = run()
    assert len(first) == 2 and {d[1] for d in first} == {"confirmed"}
    put("again.png", "a.png"), put("c.wav", "c.wav")
    second = run()
    assert len(second) == 3 and set(first) <= set(second)
    # The last batch was written but not committed, as if the driver had been lost.
    last = max(int(n) for n in os.listdir(tmp_path / "checkpoint/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        path = tmp_path / "checkpoint/commits" / name
        if path.exists():
            path.rename(tmp_path / f"lost-{name}")
    assert run() == second
