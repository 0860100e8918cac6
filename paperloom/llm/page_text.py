"""Main text of HTML pages by a recurrent block labeller.

A page is read as a sequence of blocks (``html_blocks``). Each block is a vector: its way of tags
(learnt vectors of tags, names and pieces of names, a parent counting 0.9 of its child), its words
(mean of learnt vectors of hashed words), and a few measures. A bidirectional LSTM in numpy reads
the whole sequence, so every block is labelled by what stands anywhere on its page; blocks labelled
main text are joined in page order.

It is trained here, in one task, on pages of made-up layouts (``page_layouts``) filled with words of
the given pages, and on given pages that say themselves which part is the article. Bounds of that
sample are parameters of ``LabellerSettings``; every page is then extracted whole.

Defined cases: null or empty html, and pages without main text, give the empty string; repeated rows
give repeated rows; extra columns are ignored unless kept; an empty table gives an empty table
(and a labeller trained on made-up words).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.html_blocks import Block, Ways, read_blocks
from paperloom.llm.page_layouts import Maker

NAME_BUCKETS, WORD_BUCKETS = 8192, 2048
NAME_SIZE, WORD_SIZE, HIDDEN = 16, 6, 24
_KEEP = 0.9  # of a parent's vector
_AT_ONCE = 1 << 14  # blocks labelled together, unless one page has more


@dataclass(frozen=True)
class LabellerSettings:
    #: given pages to draw words and layouts from, at most, and the largest of them in bytes
    max_pages: int = 300
    max_page_bytes: int = 100_000
    made_pages: int = 1000
    rounds: int = 6
    batch: int = 25
    rate: float = 0.01
    seed: int = 5


def name_tokens(tag: str, names: str) -> list[int]:
    """Buckets of an element's tag, its names, and four-letter pieces of long names."""
    words = []
    for name in names.split():
        split = "".join(f" {c}" if c.isupper() and k and name[k - 1].islower() else (c if c.isalpha() else " ") for k, c in enumerate(name))
        words += split.lower().split()
    tokens = [f"<{tag}"] + words + [f"~{w[k : k + 4]}" for w in words if len(w) > 5 for k in range(len(w) - 3)]
    return [crc32(t.encode()) % NAME_BUCKETS for t in tokens]


_N_MEASURES = 9


def measures(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    out = np.zeros((n, _N_MEASURES), dtype=np.float32)
    for k, b in enumerate(blocks):
        size, last = len(b.text), b.text[-1]
        out[k] = (np.log1p(size) / 4, b.linked / size, last in ".!?…\"”", b.text[0] == "©", b.text.count(" ") / size, size > 80, k / n, (n - k) / n, np.log1p(n) / 4)
    return out


def word_buckets(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """(block, bucket) of every word of every block."""
    rows, buckets, done = [], [], 0
    for w in W.blocks(pa.array([b.text for b in blocks], pa.string()), W.SPACED, lower=True):
        rows.append(w.doc + done)
        buckets.append((w.hash % np.uint64(WORD_BUCKETS)).astype(np.int64))
        done += w.rows
    return np.concatenate(rows), np.concatenate(buckets)


class WayVectors:
    """Vectors of ways, one sum and one addition a new way."""

    def __init__(self, table: np.ndarray):
        self.table, self.vectors = table, [np.zeros(table.shape[1], dtype=np.float32)]

    def of(self, ways: Ways) -> np.ndarray:
        for parent, tag, names in ways.made[len(self.vectors) :]:
            self.vectors.append(_KEEP * self.vectors[parent] + self.table[name_tokens(tag, names)].sum(0))
        return np.array(self.vectors)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Direction:
    """One LSTM over (time, page, size) inputs; a page's rows end where its length does."""

    def __init__(self, p: dict[str, np.ndarray], name: str):
        self.wx, self.wh, self.b = (p[f"{name}_{k}"] for k in ("wx", "wh", "b"))

    def forward(self, x: np.ndarray, keep: bool) -> np.ndarray:
        steps, pages, _ = x.shape
        z = x @ self.wx + self.b
        h, c = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
        out = np.empty((steps, pages, HIDDEN), x.dtype)
        self.kept = []
        for t in range(steps):
            gates = z[t] + h @ self.wh
            ifo, g = _sigmoid(gates[:, : 3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = ifo[:, HIDDEN : 2 * HIDDEN] * c + ifo[:, :HIDDEN] * g
            tanh_c = np.tanh(c)
            h = ifo[:, 2 * HIDDEN :] * tanh_c
            out[t] = h
            if keep:
                self.kept.append((ifo, g, before, h_before, tanh_c))
        return out

    def backward(self, x: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Slopes of the inputs and weights from those of the outputs."""
        steps, pages, _ = x.shape
        dz = np.empty((steps, pages, 4 * HIDDEN))
        dh, dc, dwh = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros_like(self.wh)
        for t in range(steps - 1, -1, -1):
            ifo, g, before, h_before, tanh_c = self.kept[t]
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - tanh_c**2)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dwh += h_before.T @ dz[t]
            dc, dh = dc * f, dz[t] @ self.wh.T
        flat = dz.reshape(-1, 4 * HIDDEN)
        return dz @ self.wx.T, {"wx": x.reshape(-1, x.shape[2]).T @ flat, "wh": dwh, "b": flat.sum(0)}


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pages one after another: time, page and time from the end of every block."""
    page = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    time = np.arange(lengths.sum()) - first[page]
    return time, page, lengths[page] - 1 - time


def _inputs(p: dict[str, np.ndarray], way: np.ndarray, words: tuple[np.ndarray, np.ndarray], extra: np.ndarray) -> np.ndarray:
    said = np.zeros((len(extra), WORD_SIZE), dtype=extra.dtype)
    row, bucket = words
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
    if len(at):
        said[row[at]] = np.add.reduceat(p["words"][bucket], at, axis=0) / np.diff(np.append(at, len(row)))[:, None]
    return np.concatenate([np.tanh(way), said, extra], axis=1)


def _run(p: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    time, page, back = _places(lengths)
    steps = int(lengths.max())
    ahead, behind = np.zeros((steps, len(lengths), x.shape[1]), x.dtype), np.zeros((steps, len(lengths), x.shape[1]), x.dtype)
    ahead[time, page], behind[back, page] = x, x
    fore, aft = Direction(p, "fore"), Direction(p, "aft")
    h = np.concatenate([fore.forward(ahead, keep)[time, page], aft.forward(behind, keep)[back, page], x], axis=1)
    return h, (fore, aft, ahead, behind, time, page, back)


def _label(p: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of main text for every block; pages of like length are run together."""
    out = np.empty(len(x), dtype=np.float32)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and lengths[order[hi]] * (hi + 1 - lo) <= max(_AT_ONCE, lengths[order[lo]]):
            hi += 1
        chosen = order[lo:hi]
        rows = np.concatenate([np.arange(first[k], first[k] + lengths[k]) for k in chosen])
        h, _ = _run(p, x[rows], lengths[chosen])
        out[rows] = _sigmoid(h @ p["out"] + p["bias"])
        lo = hi
    return out


#: elements that say of themselves whether they are main text
_SAID = {"article": 1, "nav": 0, "aside": 0, "footer": 0, "form": 0, "header": 0}


def said_labels(blocks: list[Block], ways: Ways) -> list[int] | None:
    """Labels of a page with exactly one outer article element, by the elements around each block."""
    labels, articles = [], set()
    for b in blocks:
        way, label, article = b.way, 0, None
        decided = False
        while way > 0:
            parent, tag, _ = ways.made[way]
            if tag in _SAID and not decided:
                label, decided = _SAID[tag], True
            if tag == "article":
                article = way
            way = parent
        labels.append(label)
        if article is not None:
            articles.add(article)
    return labels if len(articles) == 1 else None


@dataclass
class _Example:
    tokens: list[tuple[np.ndarray, np.ndarray]]  # (buckets, weights) of each block's way
    words: tuple[np.ndarray, np.ndarray]
    extra: np.ndarray
    label: np.ndarray


def _example(blocks: list[Block], ways: Ways, label: list[int]) -> _Example:
    tokens = []
    for b in blocks:
        found, weights, way, weight = [], [], b.way, 1.0
        while way > 0 and weight > 0.01:
            way, tag, names = ways.made[way]
            own = name_tokens(tag, names)
            found += own
            weights += [weight] * len(own)
            weight *= _KEEP
        tokens.append((np.array(found, dtype=np.int64), np.array(weights)))
    return _Example(tokens, word_buckets(blocks), measures(blocks), np.array(label, dtype=float))


def _examples(pages: list[str], s: LabellerSettings) -> list[_Example]:
    read, texts = [], []
    for html in pages:
        ways = Ways()
        blocks = read_blocks(html, ways)
        if blocks:
            read.append((blocks, ways))
            texts += [b.text.replace(Maker.MARK, "") for b in blocks if len(b.text) > 40]
    out = []
    for blocks, ways in read:
        label = said_labels(blocks, ways)
        if label is not None:
            out.append(_example(blocks, ways, label))
    maker = Maker(s.seed, texts)
    for _ in range(s.made_pages):
        ways = Ways()
        blocks = read_blocks(maker.page(), ways)
        label = [int(Maker.MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(Maker.MARK, "").strip() or "x"
        if blocks:
            out.append(_example(blocks, ways, label))
    return out


def fit(pages: list[str], s: LabellerSettings = LabellerSettings()) -> dict[str, np.ndarray]:
    """Weights of the labeller, by Adam on batches of pages of like length."""
    rng = np.random.default_rng(s.seed)
    size = NAME_SIZE + WORD_SIZE + _N_MEASURES
    p = {"names": np.zeros((NAME_BUCKETS, NAME_SIZE)), "words": np.zeros((WORD_BUCKETS, WORD_SIZE)), "out": rng.normal(0, 0.1, 2 * HIDDEN + size), "bias": np.zeros(1)}
    for d in ("fore", "aft"):
        p |= {f"{d}_wx": rng.normal(0, 0.15, (size, 4 * HIDDEN)), f"{d}_wh": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), f"{d}_b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
    examples = _examples(pages, s)
    seen = np.unique(np.concatenate([t for e in examples for t, _ in e.tokens])) if examples else []
    p["names"][seen] = rng.normal(0, 0.1, (len(seen), NAME_SIZE))
    p["words"] = rng.normal(0, 0.05, p["words"].shape)
    examples.sort(key=lambda e: len(e.label))
    batches = [examples[k : k + s.batch] for k in range(0, len(examples), s.batch)]
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step, total = 0, s.rounds * max(1, len(batches))
    for _ in range(s.rounds):
        for k in rng.permutation(len(batches)):
            step += 1
            slopes = _slopes(p, batches[k], rng)
            rate = s.rate * (1 - 0.95 * step / total)
            for name, g in slopes.items():
                mean[name] += 0.1 * (g - mean[name])
                square[name] += 0.01 * (g * g - square[name])
                p[name] -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _slopes(p: dict[str, np.ndarray], batch: list[_Example], rng: np.random.Generator) -> dict[str, np.ndarray]:
    lengths = np.array([len(e.label) for e in batch])
    label, extra = np.concatenate([e.label for e in batch]), np.concatenate([e.extra for e in batch]).astype(float)
    tokens = [t for e in batch for t in e.tokens]
    block = np.repeat(np.arange(len(tokens)), [len(t) for t, _ in tokens])
    bucket, weight = np.concatenate([t for t, _ in tokens]), np.concatenate([w for _, w in tokens])
    weight = weight * (rng.random(len(weight)) > 0.1)  # names must not be needed one by one
    way = np.zeros((len(tokens), NAME_SIZE))
    np.add.at(way, block, p["names"][bucket] * weight[:, None])
    first = np.cumsum(lengths) - lengths
    row, word = (np.concatenate([e.words[i] + (first[k] if i == 0 else 0) for k, e in enumerate(batch)]) for i in (0, 1))
    x = _inputs(p, way, (row, word), extra)
    h, (fore, aft, ahead, behind, time, page, back) = _run(p, x, lengths, keep=True)
    error = (_sigmoid(h @ p["out"] + p["bias"]) - label) / len(label)
    slopes = {"out": h.T @ error + 1e-5 * p["out"], "bias": np.array([error.sum()])}
    dh = error[:, None] * p["out"]
    dx = dh[:, 2 * HIDDEN :].copy()
    for d, name, given, at, lo in ((fore, "fore", ahead, time, 0), (aft, "aft", behind, back, HIDDEN)):
        slope = np.zeros((*given.shape[:2], HIDDEN))
        slope[at, page] = dh[:, lo : lo + HIDDEN]
        dgiven, own = d.backward(given, slope)
        dx += dgiven[at, page]
        slopes |= {f"{name}_{k}": v for k, v in own.items()}
    dway = dx[:, :NAME_SIZE] * (1 - np.tanh(way) ** 2)
    slopes["names"] = np.zeros_like(p["names"])
    np.add.at(slopes["names"], bucket, dway[block] * weight[:, None])
    slopes["words"] = np.zeros_like(p["words"])
    count = np.bincount(row, minlength=len(label))
    np.add.at(slopes["words"], word, dx[row, NAME_SIZE : NAME_SIZE + WORD_SIZE] / count[row][:, None])
    return slopes


def train(pages: DataFrame, settings: LabellerSettings = LabellerSettings(), id_col: str = "page_id", html_col: str = "html") -> dict[str, np.ndarray]:
    """Fit in one task on at most ``max_pages`` pages of at most ``max_page_bytes``."""
    slim = pages.select(F.xxhash64(F.lit(3), F.col(id_col)).alias("order"), F.col(html_col).cast("string").alias("html"))
    slim = slim.filter(F.octet_length("html") <= settings.max_page_bytes)
    chosen = slim.select("order").distinct().orderBy("order").limit(settings.max_pages)
    sample = slim.join(F.broadcast(chosen), "order", "left_semi").repartition(1).sortWithinPartitions("order", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        html: list[str] = []
        for batch in batches:
            html += batch.column("html").to_pylist()[: settings.max_pages - len(html)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(html, settings))], pa.binary())], ["model"])

    return pickle.loads(sample.select("html").mapInArrow(run, "model binary").first()["model"])  # weights of a fixed size


def extract(pages: DataFrame, model: dict[str, np.ndarray], html_col: str = "html", keep: list[str] = ["page_id", "url"]) -> DataFrame:
    """The kept columns, ``text``, ``n_chars`` (code points), ``n_blocks`` and ``n_main`` of every row."""
    slim = pages.select(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep))).alias("row"), F.col(html_col).cast("string").alias("html"))
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shipped.value
        ways, vectors = Ways(), WayVectors(p["names"])

        def label(held: list[list[Block]]) -> list[tuple[str, int, int]]:
            blocks = [b for page in held for b in page]
            if not blocks:
                return [("", 0, 0)] * len(held)
            lengths = np.array([len(page) for page in held])
            extra = np.concatenate([measures(page) for page in held if page])
            way = vectors.of(ways)[[b.way for b in blocks]]
            filled = lengths[lengths > 0]
            main = _label(p, _inputs(p, way, word_buckets(blocks), extra), filled) >= 0.5
            out, at = [], 0
            for page in held:
                chosen = [b.text for b, m in zip(page, main[at : at + len(page)]) if m]
                out.append(("\n".join(chosen), len(page), len(chosen)))
                at += len(page)
            return out

        for batch in batches:
            rows, html = batch.column("row"), batch.column("html")
            lo, held, n_blocks = 0, [], 0
            for k in range(batch.num_rows):
                held.append(read_blocks(html[k].as_py() or "", ways))
                n_blocks += len(held[-1])
                if n_blocks >= _AT_ONCE or k == batch.num_rows - 1:
                    found = label(held)
                    texts = [t for t, _, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [rows.slice(lo, len(held)), pa.array(texts), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
                        ["row", "text", "n_chars", "n_blocks", "n_main"],
                    )
                    lo, held, n_blocks = k + 1, [], 0
                    if len(ways.made) > 200_000:  # names that never come again
                        ways, vectors = Ways(), WayVectors(p["names"])

    kind = slim.schema["row"].dataType.simpleString()
    out = slim.mapInArrow(run, f"row {kind}, text string, n_chars long, n_blocks long, n_main long")
    return out.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(keep)), "text", "n_chars", "n_blocks", "n_main")
