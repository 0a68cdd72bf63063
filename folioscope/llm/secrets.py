"""Operator 8, secret scans: base patterns, and a character convolutional network over candidates.

Base findings come from three patterns and always stay. Every candidate (a run of 12 or more token
characters that is no plain word: digits, inner capitals or signs in it) is judged with its surrounding
context by a small network in numpy: character embedding, one convolution, the largest and the mean
response inside the candidate and the largest in the context, two dense layers.

It is fitted on labelled windows, on all of them. Found are the base findings and generated secrets of random
shapes; none are candidates of the corpus without a key-like context or finding and generated tokens of other kinds.
Every distinct window of the corpus also lends its context to a generated one of either label, so the context alone
tells nothing. Candidates that no pattern takes, but that change often between letters, digits and cases or stand where
a key is named, are not labelled at all: what the patterns miss is not learned as harmless.

The fit begins on the driver with generated windows alone (their number is fixed), then goes EPOCHS times over the whole
table in SLICES steps: tasks sum the gradients of a slice's windows, the driver takes a step by the sums. However many
windows a group has (of the corpus or generated, by label), together they weigh no more than MOST_WEIGHT windows.

A fifth of all windows was not trained on: it calibrates the scores (Platt scaling, losses summed by tasks) and sets the
threshold, of all that find RECALL of the held-out secrets the most precise, of equals the lowest (exact, by running sums
over ranges of scores).

Positions are code points. A network span may hold base spans or overlap them; what is cut out of a text is the union
of all spans. Defined results: a null or empty text has no findings; equal rows are
judged one by one; candidates longer than a window are judged window by window, the highest counts; a
score equal to the threshold is a finding.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keep_only, materialise, slices

#: What a group of windows weighs at most, generated windows of each label beside the corpus for training and for calibration.
MOST_WEIGHT, GENERATED, HELD, RECALL = 2_000, 2_400, 800, 0.95
#: Steps that go once over all windows, how often they do, and windows of a task of a step (at least).
SLICES, EPOCHS, TASK_WINDOWS = 12, 4, 20_000
BEFORE, INSIDE, AFTER = 24, 48, 8
KINDS = ["assign", "access", "hex", "network"]
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
_RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")
#: Runs that are plain words or several of them.
_PLAIN = re.compile(rb"[.=-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[.=-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[.=-]*|[.=_/+-]+")
#: What stands before a value that is named, so that a corpus token after it is no sure negative.
_KEYED = re.compile(rb"[:=]\x20*[\"']?\Z|(?:key|token|secret|passw|pwd|auth|bearer|credential)[^\n]{0,16}\Z", re.I)
#: One byte per code point; what Latin-1 lacks becomes "?", which no pattern takes.
_IS_HEX = bytes(ord("h") if chr(c) in "0123456789abcdef" else 32 for c in range(256))
#: Where letters, digits and cases change within a word: often in what is random.
_SWITCH = re.compile(rb"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")


def base_spans(flat: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in the order of a report."""
    out = []
    if b"=" in flat or b":" in flat:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(flat) if len(m[2]) >= 12]
    if b"AKIA" in flat:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(flat) if m.end() - m.start() >= 18]
    if b"h" * 16 in flat.translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(flat) if m.end() - m.start() >= 16]
    return sorted(out)


def candidates(flat: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(flat) if not _PLAIN.fullmatch(m[0])]


def windows(flat: bytes, start: int, end: int) -> list[bytes]:
    """The candidate with its context, cut into windows of equal length (zero bytes fill up)."""
    out = []
    for at in range(start, end, INSIDE):
        to = min(end, at + INSIDE)
        out.append(flat[max(0, at - BEFORE) : at].rjust(BEFORE, b"\0") + flat[at:to].ljust(INSIDE, b"\0") + flat[to : to + AFTER].ljust(AFTER, b"\0"))
    return out


def flat_of(text: str | None) -> bytes:
    return (text or "").encode("latin-1", "replace")


class CharNetwork:
    CLASSES, DIM, WIDTH, FILTERS, HIDDEN = 97, 8, 5, 24, 16

    def __init__(self, seed: int = 8):
        r = np.random.default_rng(seed)
        d = self.DIM * self.WIDTH
        shapes = {"E": (self.CLASSES, self.DIM), "W": (d, self.FILTERS), "b": (self.FILTERS,), "V": (3 * self.FILTERS, self.HIDDEN), "c": (self.HIDDEN,), "u": (self.HIDDEN,), "e": ()}
        self.p = {k: r.normal(0, 0.3 if len(s) > 1 else 0.1, s) for k, s in shapes.items()}
        self.p["e"] = np.zeros(())
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        p = self.p
        c = np.where((x >= 32) & (x < 127), x - 31, np.where(x == 0, 0, 96)).astype(np.intp)
        emb = np.pad(p["E"][c] * (c > 0)[..., None], ((0, 0), (2, 2), (0, 0)))
        cols = np.concatenate([emb[:, i : i + x.shape[1]] for i in range(self.WIDTH)], 2)
        act = np.maximum(cols @ p["W"] + p["b"], 0)
        inside = np.zeros(x.shape, bool)
        inside[:, BEFORE : BEFORE + INSIDE] = True
        blank = (c == 0)[..., None]
        in_act = np.where(inside[..., None] & ~blank, act, 0)
        out_act = np.where(~inside[..., None] & ~blank, act, 0)
        i, o = in_act.argmax(1), out_act.argmax(1)
        size = np.maximum((inside & ~blank[..., 0]).sum(1), 1)
        pooled = np.concatenate([np.take_along_axis(in_act, i[:, None], 1)[:, 0], np.take_along_axis(out_act, o[:, None], 1)[:, 0], in_act.sum(1) / size[:, None]], 1)
        hidden = np.maximum(pooled @ p["V"] + p["c"], 0)
        return c, cols, i, o, in_act > 0, size, pooled, hidden, hidden @ p["u"] + p["e"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -35, 35)))

    def _gradients(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.FILTERS
        c, cols, i, o, on, size, pooled, hidden, z = self._forward(x)
        dz = w * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(x)
        dh = np.outer(dz, p["u"]) * (hidden > 0)
        dp = (dh @ p["V"].T) * (pooled > 0)
        dact = np.zeros((len(x), x.shape[1], f))
        rows, fs = np.arange(len(x))[:, None], np.arange(f)[None]
        np.add.at(dact, (rows, i, fs), dp[:, :f])
        np.add.at(dact, (rows, o, fs), dp[:, f : 2 * f])
        dact += on * (dh @ p["V"][2 * f :].T / size[:, None])[:, None]
        dcols = dact @ p["W"].T
        demb = np.zeros((len(x), x.shape[1] + 4, self.DIM))
        for k in range(self.WIDTH):
            demb[:, k : k + x.shape[1]] += dcols[..., k * self.DIM : (k + 1) * self.DIM]
        demb = demb[:, 2:-2] * (c > 0)[..., None]
        dE = np.zeros_like(p["E"])
        np.add.at(dE, c.ravel(), demb.reshape(-1, self.DIM))
        return {"E": dE, "W": np.tensordot(cols, dact, ((0, 1), (0, 1))), "b": dact.sum((0, 1)), "V": pooled.T @ dh, "c": dh.sum(0), "u": hidden.T @ dz, "e": dz.sum()}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01) -> None:
        """Adam over shuffled batches, both labels of equal weight."""
        r, own = np.random.default_rng(88), np.arange(len(x))
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        adam, steps = Adam(self.p), epochs * -(-len(x) // 64)
        for _ in range(epochs):
            r.shuffle(own)
            for at in range(0, len(own), 64):
                b = own[at : at + 64]
                self.p = adam.step(self.p, self._gradients(x[b], y[b], weight[b]), rate * (1 - (adam.t + 1) / (steps + 1)))

    def summed(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Gradients of the weighted losses, summed over windows, one after another."""
        out = np.zeros(sum(v.size for v in self.p.values()))
        for at in range(0, len(x), 512):
            g = self._gradients(x[at : at + 512], y[at : at + 512], w[at : at + 512])
            out += np.concatenate([np.ravel(g[k]) for k in self.p]) * len(x[at : at + 512])
        return out

    def parted(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([v.size for v in self.p.values()])[:-1]
        return {k: part.reshape(v.shape) for (k, v), part in zip(self.p.items(), np.split(flat, ends))}


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], gradients: dict[str, np.ndarray], rate: float) -> dict[str, np.ndarray]:
        self.t, out = self.t + 1, {}
        for k, g in gradients.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            out[k] = p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return out


#: Scales and shifts that calibration chooses from: a grid keeps it finite where labels part cleanly.
_GRID = [(a, b) for a in np.geomspace(0.05, 4, 40).tolist() for b in np.linspace(-5, 5, 41).tolist()]


def platt_losses(z: np.ndarray, y: np.ndarray, w: np.ndarray, targets: tuple[float, float]) -> np.ndarray:
    """The weighted loss of each of _GRID, summed over windows; targets: of label 0 and of 1 (smoothed)."""
    out, (a, b) = np.zeros(len(_GRID)), np.array(_GRID).T
    for at in range(0, len(z), 512):
        t = np.clip(a[:, None] * z[at : at + 512] + b[:, None], -35, 35)
        target = np.where(y[at : at + 512] == 1, targets[1], targets[0])
        out += (np.log1p(np.exp(-np.abs(t))) + np.maximum(t, 0) - target * t) @ w[at : at + 512]
    return out


def threshold_of(p: np.ndarray, y: np.ndarray) -> float:
    """Of the thresholds that find RECALL of the secrets the most precise, of equals the lowest."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.append(p[1:] != p[:-1], True)  # equal scores are taken together
    found, taken = np.cumsum(y), np.arange(1, len(y) + 1)
    fit = last & (found >= RECALL * y.sum())
    precision = np.where(fit, found / taken, -1.0)
    return float(p[np.flatnonzero(precision == precision.max())[-1]])


_ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_letters]


def _secret_shape(r: random.Random):
    """A random kind of secret: an alphabet, one to four parts with a sign between, perhaps a prefix."""
    abc, sign = r.choice(_ALPHABETS), r.choice("._-")
    parts = [r.choice([16, 20, 24, 27, 32, 36, 40, 43, 48, 64])] if r.random() < 0.6 else [r.randrange(4, 30) for _ in range(r.randrange(2, 5))]
    if sum(parts) < 16:
        parts[-1] += 16
    lead = "".join(r.choice(string.ascii_letters) for _ in range(r.randrange(2, 5))) + r.choice("_-.") if r.random() < 0.4 else ""
    end = "=" * r.choice([0, 0, 0, 1, 2])
    return lambda: lead + sign.join("".join(r.choice(abc) for _ in range(n)) for n in parts) + end


def _other_shape(r: random.Random):
    """A random kind of token that is none: addresses, dates, versions, paths, names, numbers."""
    ending = r.choice(["example.com", "example.org", "example.net", "test.io"])
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def word(cap: bool = False) -> str:
        w = "".join(r.choice("bcdfghlmnprstvw") + r.choice("aeiou") + r.choice(["", "n", "r", "s", "t"]) for _ in range(r.randrange(1, 5)))
        return w.capitalize() if cap else w

    sign, n = r.choice("_-./"), r.randrange(2, 5)
    return r.choice([
        lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.{ending}", lambda: f"mail{digits(1)}.{ending}",
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}T{digits(2)}.{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.20{digits(2)}-{digits(2)}.{digits(2)}.20{digits(2)}",
        lambda: f"version-{digits(1)}.{digits(2)}.{digits(1)}-{word()}", lambda: sign.join(word() for _ in range(n)) + digits(r.randrange(1, 4)), lambda: "/".join(word() for _ in range(n)) + f"/{word()}{digits(2)}.html",
        lambda: f"www.{word()}{digits(1)}.{ending}/{word()}", lambda: f"+{digits(2)}-{digits(3)}-{digits(3)}-{digits(4)}", lambda: word() + "".join(word(True) for _ in range(n)), lambda: "_".join(word() for _ in range(n)),
        lambda: f"{word(True)}-{word(True)}/{word(True)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(2)}", lambda: f"{word()}{word()}{digits(r.randrange(1, 5))}.{r.choice(['txt', 'png', 'csv', 'json'])}", lambda: digits(1) + "." + digits(r.randrange(11, 18)),
        lambda: "=".join([word(), word() + digits(2)]) + "=" * r.randrange(3), lambda: f"{word(True)}{word()}.{word(True)}{word()}", lambda: "-" * r.randrange(3, 9) + digits(2) + "-" * r.randrange(9, 14), lambda: f"{word()}--{word()}{digits(1)}--{word()}",
    ])


def generated(seed: int, each: int, around: list[tuple[bytes, bytes]]) -> list[tuple[bytes, int]]:
    """Labelled windows, about `each` of both labels: secrets of random shapes, and tokens that are none,
    set into the contexts `around` (and some that name a value)."""
    r = random.Random(seed)
    named = [b"key: ", b'api = "', b"access=", b"bearer ", b"credentials ", b"value: ", b"id=", b'name="', b"see ", b"(", b"ref "]
    out: list[tuple[bytes, int]] = []
    for label, shape in ((1, _secret_shape), (0, _other_shape)):
        made = 0
        while made < each:
            make = shape(r)
            for _ in range(4):
                if around and r.random() < 0.7:
                    before, after = r.choice(around)
                else:
                    before = bytes(r.choices(b"etaoinshr ", k=12)) + b" " + r.choice(named)
                    after = r.choice([b" and", b'" of', b", in", b"\nthe"])
                core = make().encode()
                flat = before + core + after
                found = windows(flat, len(before), len(before) + len(core))
                out += [(w, label) for w in found]
                made += len(found)
    return out


def generated_in(window: bytes) -> list[tuple[bytes, int]]:
    """A generated secret or other token in the context of a window, which decides on label and shape."""
    seed = xxhash.xxh64_intdigest(window, 82)
    r, label = random.Random(seed), seed & 1
    before, core, after = window[:BEFORE].lstrip(b"\0"), (_secret_shape if label else _other_shape)(r)().encode(), window[BEFORE + INSIDE :].rstrip(b"\0")
    return [(w, label) for w in windows(before + core + after, len(before), len(before) + len(core))]


def labelled_windows(docs: DataFrame, text_col: str) -> DataFrame:
    """window, label: all distinct windows of the corpus that have a label; one scan of the texts."""
    src = docs.select(F.col(text_col).cast("string").alias("text"))

    def labelled(batches):
        keep_only()
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                flat = flat_of(text)
                found = candidates(flat)
                base = base_spans(flat) if found else []
                for s, e in found:
                    label = int(any(x < e and s < y for x, _, y in base))
                    if label or 8 * len(_SWITCH.findall(flat[s:e])) <= e - s + 8 and not _KEYED.search(flat[max(0, s - BEFORE) : s]):
                        rows += [(w, label) for w in windows(flat, s, e)]
            if rows:
                yield _window_batch(rows)

    return materialise(src.mapInArrow(labelled, "window binary, label int").distinct(), "labelled-windows")


def _window_batch(rows: list[tuple], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in rows], pa.binary()), "label": pa.array([y for _, y in rows], pa.int32())} | more)


def training_windows(labelled: DataFrame, n: int) -> DataFrame:
    """window, label, own (of the corpus), slice (-1: held out) of the n windows and of generated ones in their contexts,
    in a folder per slice."""

    def grow(batches):
        keep_only()
        for b in slices(batches):
            own = list(zip(b.column("window").to_pylist(), b.column("label").to_pylist()))
            made = [x for w, _ in own for x in generated_in(w)]
            at = [xxhash.xxh64_intdigest(w, 8) for w, _ in own + made]
            yield _window_batch(own + made, own=pa.array([True] * len(own) + [False] * len(made)), slice=pa.array([-1 if h % 5 == 0 else h // 5 % SLICES for h in at], pa.int32()))

    grown = labelled.mapInArrow(grow, "window binary, label int, own boolean, slice int")
    return materialise(grown.repartition(min(200, 1 + n // TASK_WINDOWS), "window"), "training-windows", by=["slice"])


def _weights(counts: dict[tuple[bool, int], int]) -> dict[tuple[bool, int], float]:
    """(own, label) -> the weight of one window of this group."""
    return {group: min(n, MOST_WEIGHT) / n for group, n in counts.items()}


def _read(b: pa.RecordBatch, weights: dict[tuple[bool, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column("window").to_pylist()), np.uint8).reshape(b.num_rows, -1)
    y = b.column("label").to_numpy(zero_copy_only=False)
    return x, y, np.array([weights[g] for g in zip(b.column("own").to_pylist(), y.tolist())])


def _sums(rows: DataFrame, of_batch) -> np.ndarray:
    """of_batch's arrays over all rows, summed by tasks, then in the order of the tasks."""

    def run(batches):
        keep_only()
        parts = [of_batch(b) for b in slices(batches)]
        if parts:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([np.sum(parts, axis=0).tolist()], pa.list_(pa.float64()))})

    got = rows.mapInArrow(run, "sums array<double>").select(F.spark_partition_id().alias("part"), "sums").collect()
    return np.sum([r.sums for r in sorted(got)], axis=0) if got else np.zeros(1)


def threshold_over(scored: DataFrame) -> float:
    """threshold_of over a table (z, label, w) of any size: the z of the threshold. Ranges of z run from the highest down; each
    begins with the sums of those before it."""
    spark = scored.sparkSession
    each = scored.groupBy("z").agg(F.sum(F.col("label") * F.col("w")).alias("found"), F.sum("w").alias("taken"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = each.repartitionByRange(parts, F.desc("z")).sortWithinPartitions(F.desc("z")).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "score-ranges", by=["part"])
    sums = {r.part: (r.found, r.taken) for r in ranged.groupBy("part").agg(F.sum("found").alias("found"), F.sum("taken").alias("taken")).collect()}
    before, so_far = {}, (0.0, 0.0)
    for part in sorted(sums):
        before[part] = so_far
        so_far = (so_far[0] + sums[part][0], so_far[1] + sums[part][1])
    # a little room for the order of the sums
    wanted = RECALL * so_far[0] * (1 - 1e-12)

    def best_of(key, rows):
        z, found, taken = (rows.column(c).to_numpy() for c in ("z", "found", "taken"))
        order = np.argsort(-z, kind="stable")
        base = before[key[0].as_py()]
        found, taken = base[0] + np.cumsum(found[order]), base[1] + np.cumsum(taken[order])
        precision = np.where(found >= wanted, np.round(found / taken, 12), -1.0)
        at = np.flatnonzero(precision == precision.max())[-1]
        return pa.table({"precision": [float(precision[at])], "z": [float(z[order][at])]})

    best = ranged.groupBy("part").applyInArrow(best_of, "precision double, z double").collect()
    return min((-r.precision, r.z) for r in best)[1]


def fit_network(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> CharNetwork:
    """Fit on all labelled candidates of the corpus and on generated ones."""
    arrays = lambda rows: (np.frombuffer(b"".join(w for w, _ in rows), np.uint8).reshape(len(rows), -1), np.array([y for _, y in rows]))
    labelled = labelled_windows(docs, text_col)
    rows = training_windows(labelled, labelled.count())
    counts = {(r.held, r.own, r.label): r["count"] for r in rows.groupBy((F.col("slice") < 0).alias("held"), "own", "label").count().collect()}
    weights, held_weights = (_weights({k[1:]: n for k, n in counts.items() if k[0] == held}) for held in (False, True))
    x, y = arrays(generated(80, GENERATED, []))
    network = CharNetwork()
    network.fit(x, y)
    if weights:
        # both labels weigh the same; a slice is taken for its share of the whole
        by_label = [sum(n * weights[k[1:]] for k, n in counts.items() if not k[0] and k[2] == label) + int((y == label).sum()) for label in (0, 1)]
        even = [SLICES / (2 * total) for total in by_label]
        weights = {k: w * even[k[1]] for k, w in weights.items()}
        w, adam = np.array(even)[y], Adam(network.p)
        for step in range(SLICES * EPOCHS):
            part = rows.filter(F.col("slice") == step % SLICES)
            gradients = _sums(part, lambda b: network.summed(*_read(b, weights))) + network.summed(*(a[step % SLICES :: SLICES] for a in (x, y, w)))  # noqa: B023
            network.p = adam.step(network.p, network.parted(gradients), 0.01 * (1 - adam.t / (SLICES * EPOCHS)))
    # ---- calibration
    hx, hy = arrays(generated(81, HELD, []))
    hz = network.logits(hx)

    def score(batches):
        keep_only()
        for b in slices(batches):
            bx, by, bw = _read(b, held_weights)
            yield pa.RecordBatch.from_pydict({"z": pa.array(network.logits(bx)), "label": pa.array(by, pa.int32()), "w": pa.array(bw)})

    schema = "z double, label int, w double"
    fixed = docs.sparkSession.createDataFrame([(float(z), int(label), 1.0) for z, label in zip(hz, hy)], schema)
    scored = materialise(rows.filter("slice = -1").mapInArrow(score, schema).unionByName(fixed), "held-out-scores")
    yes, no = (sum(n * held_weights[k[1:]] for k, n in counts.items() if k[0] and k[2] == label) + int((hy == label).sum()) for label in (1, 0))
    targets = (1 / (no + 2), (yes + 1) / (yes + 2))
    losses = _sums(scored, lambda b: platt_losses(b.column("z").to_numpy(), b.column("label").to_numpy(), b.column("w").to_numpy(), targets))
    network.scale, network.shift = _GRID[int(np.argmin(losses))]
    z = threshold_over(scored)
    network.threshold = float(1 / (1 + np.exp(-np.clip(network.scale * z + network.shift, -35, 35))))
    return network


def find(flat: bytes, network: CharNetwork) -> list[tuple[int, int, int]]:
    """All findings, (start, kind, end): base ones, and candidates that the network takes. A candidate all of whose code
    points base findings hold is these findings; one that goes on beyond them is a finding beside them."""
    base, own = base_spans(flat), candidates(flat)
    if own:
        parts = [windows(flat, s, e) for s, e in own]
        scores = network.scores(np.frombuffer(b"".join(w for p in parts for w in p), np.uint8).reshape(-1, BEFORE + INSIDE + AFTER))
        at, more = 0, []
        for (s, e), p in zip(own, parts):
            if scores[at : at + len(p)].max() >= network.threshold and not covered(s, e, base):
                more.append((s, 3, e))
            at += len(p)
        base += more
    return sorted(base)


def covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether the spans, in order of their starts, together hold all from start to end."""
    for s, _, e in spans:
        if s <= start < e:
            start = e
    return start >= end


def redact(text: str | None, spans: list[tuple[int, int, int]], by: str = "[secret]") -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def report(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; with_text also redacted_text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_network(docs, id_col=id_col, text_col=text_col))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        keep_only()
        network = sent.value
        for b in slices(batches):
            counts, digests, reports, clean = ([], [], []), [], [], []
            for text in b.column("text").to_pylist():
                spans = find(flat_of(text), network)
                base = [x for x in spans if x[1] < 3]
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(report(base).encode()).hexdigest())
                reports.append(report(spans))
                if with_text:
                    clean.append(redact(text, spans))
            cols = {"doc_id": b.column("doc_id")} | {f"n_{n}": pa.array(c, pa.int64()) for n, c in zip(KINDS, counts)} | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(reports, pa.string())}
            yield pa.RecordBatch.from_pydict(cols | ({"redacted_text": pa.array(clean, pa.string())} if with_text else {}))

    return src.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted_text string" * with_text)


def redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """All rows of docs with their findings cut out of the text (and its length set anew where the
    text changed); other columns as they are; one pass over the texts beside the fit, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_network(docs, id_col=id_col, text_col=text_col))
    sized = size_col in docs.columns

    def clean(batches):
        keep_only()
        network = sent.value
        for b in slices(batches):
            old = b.column(text_col).to_pylist()
            new = [redact(x, find(flat_of(x), network)) for x in old]
            at, kind = b.schema.get_field_index(text_col), b.schema.field(text_col)
            columns = list(b.columns)
            columns[at] = pa.array(new, kind.type)
            if sized:
                k = b.schema.get_field_index(size_col)
                columns[k] = pa.array([n if x == y else len(y) for n, x, y in zip(b.column(k).to_pylist(), old, new)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(clean, docs.schema)
