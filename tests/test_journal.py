"""The log of edits against edits done one after another, and folders of spools."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import signal
from pulsegrid.sources import journal, spools

SIDE = 6


class ByHand:
    def __init__(self, pixels, edges, shifts):
        self.pixels, self.edges, self.shifts = dict(pixels), set(edges), dict(shifts)

    def copy(self):
        return ByHand(self.pixels, self.edges, self.shifts)

    def do(self, e):
        kind = e["kind"]
        at = e.get("frame"), e.get("label")
        if kind == "paint":
            if (e["frame"], e["y"], e["x"]) in self.pixels:
                self.pixels[e["frame"], e["y"], e["x"]] = e["value"]
        elif kind == "change" and e["label"]:
            self.pixels = {k: e["value"] if (k[0], v) == at else v for k, v in self.pixels.items()}
        elif kind == "link" and e["frame"] != e["to_frame"]:
            a, b = sorted([at, (e["to_frame"], e["to_label"])])
            self.edges = {x for x in self.edges if x[2:] != b} | {(*a, *b)}
        elif kind == "unlink_left":
            self.edges = {x for x in self.edges if x[2:] != at}
        elif kind == "unlink_right":
            lost = {x[2:] for x in self.edges if x[:2] == at}
            self.edges = {x for x in self.edges if x[2:] not in lost}
        elif kind == "shift":
            self.shifts[e["frame"]] = (e["dx"], e["dy"])


def some_edits(rng, n):
    out = []
    for _ in range(n):
        f, label = rng.randrange(3), rng.randrange(5)
        out.append(
            rng.choice(
                [
                    {"kind": "paint", "frame": f, "y": rng.randrange(SIDE), "x": rng.randrange(SIDE), "value": rng.randrange(5)},
                    {"kind": "change", "frame": f, "label": label, "value": rng.randrange(6)},
                    {"kind": "link", "frame": f, "label": label, "to_frame": rng.randrange(3), "to_label": rng.randrange(5)},
                    {"kind": "unlink_left", "frame": f, "label": label},
                    {"kind": "unlink_right", "frame": f, "label": label},
                    {"kind": "shift", "frame": f, "dx": rng.random(), "dy": rng.random()},
                ]
            )
        )
    return out


def start(rng):
    pixels = {(f, y, x): rng.randrange(5) for f in range(3) for y in range(SIDE) for x in range(SIDE)}
    edges = {(f, a, f + 1, b) for f in range(2) for a in range(5) for b in range(5) if rng.random() < 0.3}
    return ByHand(pixels, edges, {1: (0.5, -0.5)})


def same(state, want):
    assert {(r.frame, r.y, r.x): r.label for r in state["pixels"].collect()} == want.pixels
    assert sorted((r.frame, r.label, r.next_frame, r.next_label) for r in state["edges"].collect()) == sorted(want.edges)
    assert {r.frame: (r.dx, r.dy) for r in state["shifts"].collect()} == want.shifts


def tables(spark, b):
    return (
        spark.createDataFrame([(*k, v, 1.5) for k, v in b.pixels.items()], "frame long, y long, x long, label int, dc double"),
        spark.createDataFrame([(f, a, c, 0.7) for f, a, _, c in b.edges], "frame long, label long, next_label long, score double"),
        spark.createDataFrame([(f, *d) for f, d in b.shifts.items()], "frame long, dx double, dy double"),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_as_one_after_another(spark, seed):
    rng = random.Random(seed)
    b = start(rng)
    before, edits = tables(spark, b), some_edits(rng, 120)
    names = [c.split()[0] for c in journal.EDIT.split(", ")]
    log = spark.createDataFrame([tuple({**e, "seq": k}.get(n) for n in names) for k, e in enumerate(edits)], journal.EDIT).repartition(3)
    for e in edits:
        b.do(e)
    state = {n: f(t, log) for (n, f), t in zip(journal.REPLAY.items(), before, strict=True)}
    same(state, b)
    assert state["pixels"].schema["label"].dataType.simpleString() == "int" and state["pixels"].columns == before[0].columns


def test_edit_checkpoint_reset(spark, tmp_path):
    rng = random.Random(7)
    b = start(rng)
    j = journal.Journal(spark, str(tmp_path / "s"))
    j.begin(*tables(spark, b))
    with pytest.raises(ValueError, match="holds"):
        j.begin(*tables(spark, b))
    first = b.copy()
    same(j.state(), first)

    def edit(n):
        for e in (edits := some_edits(rng, n)):
            b.do(e)
        j.append(*edits)

    edit(10)
    edit(10)
    same(journal.Journal(spark, str(tmp_path / "s")).state(), b)
    assert j.checkpoint() == 1
    second = b.copy()
    edit(15)
    same(j.state(), b)
    j.reset(0)
    same(j.state(), first)
    b = first.copy()
    edit(5)
    same(j.state(), b)
    j.reset(1)
    j.reset(1)
    same(j.state(), second)
    b = second.copy()
    edit(5)
    assert j.checkpoint() == 2
    edit(5)
    same(j.state(), b)
    assert sorted(j.versions()) == [0, 1, 2]
    with pytest.raises(ValueError, match="no version"):
        j.reset(9)
    with pytest.raises(ValueError, match="no edit"):
        j.append({"kind": "smudge"})


def spool(folder, name, h=4, w=3, n=6, files=("a.ini", "a.sifx"), cycle=0.1):
    rng = np.random.default_rng(len(name))
    d = folder / name
    d.mkdir(parents=True)
    for f in files:
        (d / f).write_bytes(f"[data]\r\nAOIHeight = {h}\r\nAOIWidth={w}\r\nCycleTime = {cycle}\r\nnote=a=b\r\nbare\r\n".encode() if f.endswith(".ini") else b"x")
    frames = rng.integers(0, 1000, (n, 4 if h == "?" else h, w)).astype("<u2")
    for k in range(0, n, 2):
        (d / f"{k:05d}.dat").write_bytes(frames[k : k + 2].tobytes())
    return frames


def reader():
    def read(file, raw, known):  # made here, since tasks don't know this module
        h, w = int(known["AOIHeight"]), int(known["AOIWidth"])
        return [(int(file[:5]) + k, image) for k, image in enumerate(np.frombuffer(raw, "<u2").reshape(-1, h, w))]

    return read


def test_spools_from_folders_to_lanes(spark, tmp_path):
    want = {n: spool(tmp_path, n) for n in ("Spool_2 PM", "Spool_1 AM", "Spool+3 AM", "other")}
    found = spools.scan(spark, str(tmp_path))
    assert sorted((r.spool, r.n_ini, r.n_sifx, r.h, r.w, r.reason) for r in found.collect()) == sorted((n, 1, 1, 4, 3, None) for n in want)
    some = spools.chosen(found, 0, 2, "Spool")
    assert [(r.spool, r.settings["CycleTime"], r.settings["note"]) for r in some.orderBy("place").collect()] == [("Spool+3 AM", "0.1", "a=b"), ("Spool_2 PM", "0.1", "a=b")]
    lanes = {(r.meas_id, r.y, r.x): r.signal for r in signal.to_lanes(spools.decode(spark, str(tmp_path), some, reader()), ["meas_id", "y", "x"]).collect()}
    assert lanes == {(n, y, x): want[n][:, y, x].tolist() for n in ("Spool+3 AM", "Spool_2 PM") for y in range(4) for x in range(3)}
    with pytest.raises(ValueError, match="left"):
        spools.chosen(found, 4)


def test_refused_spools(spark, tmp_path):
    spool(tmp_path / "a", "good")
    spool(tmp_path / "a", "two", files=("a.ini", "b.ini", "a.sifx"))
    spool(tmp_path / "a", "none", files=("a.ini",))
    spool(tmp_path / "a", "blank", h="?")
    assert {r.spool: r.reason for r in spools.scan(spark, str(tmp_path / "a")).collect()} == {"good": None, "two": "files", "none": "files", "blank": "no size"}
    spool(tmp_path / "b", "good")
    spool(tmp_path / "b", "wide", w=9)
    found = spools.scan(spark, str(tmp_path / "b"))
    assert {r.spool: r.reason for r in found.collect()} == {"good": "sizes", "wide": "sizes"}
    with pytest.raises(ValueError, match=r"good \(sizes\)"):
        spools.chosen(found)
    assert found.filter(F.col("spool") == "wide").first().w == 9
