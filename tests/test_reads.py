"""Reads of folders that change, and hand-overs that are read once."""

import os

import pytest
from pyspark.sql import functions as F

from treeloom.sources import stable as S
from treeloom.streaming import handover as H


def put(folder, name, text, at=1_000_000_000):
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def test_a_folder_that_changes_between_listings(spark, tmp_path):
    for name in ("same", "grows", "touched", "goes", "gone before it is read", "later"):
        put(tmp_path, name, name)
    put(tmp_path, "large", "x" * 101)
    put(tmp_path, "exact", "x" * 100)
    before = S.listing(spark, str(tmp_path))
    put(tmp_path, "grows", "x" * 101)
    (tmp_path / "gone before it is read").unlink()
    put(tmp_path, "new", "n")
    read = S.contents(spark, str(tmp_path), 100)
    put(tmp_path, "touched", "touched", 1_000_000_005)
    put(tmp_path, "later", "LATER!")
    (tmp_path / "goes").unlink()
    got = {r.path.rsplit("/", 1)[-1].replace("%20", " "): (r.outcome, r.content and bytes(r.content)) for r in S.stable(before, read, S.listing(spark, str(tmp_path)), 100).collect()}
    assert got == {
        "same": ("ok", b"same"), "exact": ("ok", b"x" * 100), "large": ("oversized", None), "grows": ("oversized", None), "touched": ("changed", None), "goes": ("unavailable", None), "gone before it is read": ("unavailable", None), "later": ("changed", None),
    }
    assert {r.outcome for r in S.stable_read(spark, str(tmp_path), 200).collect()} == {"ok"}


FRAME = H.HEAD + "\nmode: design\n\n"


@pytest.mark.parametrize(("data", "want"), [
    (FRAME + "do it\n", ("design", "do it\n", None)), (FRAME.replace("\n", "\r\n") + "x", ("design", "x", None)), (FRAME + " \n", (None, None, "empty")), (FRAME.replace("design", "other") + "x", (None, None, "framing")), (" " + FRAME + "x", (None, None, "framing")),
    (FRAME.replace("\n\n", "\r\n\n") + "x", (None, None, "framing")), ("", (None, None, "framing")), (FRAME + "x" * (H.LIMIT - len(FRAME)), ("design", "x" * (H.LIMIT - len(FRAME)), None)), (FRAME + "x" * (H.LIMIT - len(FRAME) + 1), (None, None, "too_large")),
])
def test_frames(spark, data, want):
    rows = spark.createDataFrame([(bytearray(data.encode()),)], "data binary").select(H.parsed(F.col("data")).alias("h"))
    assert tuple(rows.first().h) == want


def test_bytes_that_are_no_text(spark):
    rows = spark.createDataFrame([(bytearray(FRAME.encode() + b"\xff"),), (None,)], "data binary").select(H.parsed(F.col("data")).alias("h"))
    assert [r.h.error for r in rows.collect()] == ["not_text", "missing"]


def test_a_hand_over_is_read_once(spark, tmp_path):
    folder, out, notes = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "notes")
    folder.mkdir()
    (folder / "a").write_text(FRAME + "first")
    (folder / "b").write_text("nonsense")
    take = lambda: (H.consume(spark, str(folder), out, notes).awaitTermination(60), sorted((r.path.rsplit("/", 1)[-1], r.body, r.error) for r in spark.read.parquet(out).collect()))[1]
    once = [("a", "first", None), ("b", None, "framing")]
    assert take() == once
    assert take() == once  # a second start reads nothing
    (folder / "c").write_text(FRAME + "next")
    assert take() == [*once, ("c", "next", None)]
    assert not {"a", "b"} & set(os.listdir(folder))
