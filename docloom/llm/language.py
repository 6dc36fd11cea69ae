"""Missing or wrong language labels: a byte convolutional network, trained in numpy, per line and document.

Text is read as bytes in windows of fixed length.  Filters of several widths run over embedded bytes,
the maximum of each filter over the window goes to a softmax.  The network is fitted on a bounded
sample of labelled rows; labels may be wrong here and there, so after half of the training windows
that the network contradicts firmly take the label it gives them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codes and names of the languages, as they are written in the five languages.
NAMES = {
    "en": "en eng english anglais inglés ingles inglês englisch",
    "fr": "fr fra fre french français francais francés frances francês französisch franzosisch",
    "es": "es spa esp spanish español espanol castellano castilian espagnol espanhol spanisch",
    "pt": "pt por portuguese português portugues portugais portugués portugiesisch",
    "de": "de deu ger german deutsch allemand alemán aleman alemão alemao",
}
LANGUAGES = tuple(NAMES)
LINE_END = re.compile("\r\n|[\r\n\x85  ]")
_WORD = re.compile(r"[^\W_]+")
#: Labelled rows the network is fitted on at most, windows of one language at most, bytes of a window.
SAMPLE_ROWS, SAMPLE_WINDOWS, WINDOW = 6_000, 2_600, 96
#: How much likelier, as a logarithm, a line is in its document's main language than in another.
PRIOR = 1.5


@cache
def _aliases(names: tuple[tuple[str, str], ...]) -> dict[str, str]:
    return {name: code for code, every in names for name in every.split()}


def named_language(label: str | None, names: dict[str, str] = NAMES) -> str | None:
    """The one language a label names by code or name, with or without country; None if none or several."""
    parts = [p for p in re.split(r"[,;/+&|]|\band\b|\bet\b", (label or "").strip().lower()) if p.strip()]
    if len(parts) != 1:
        return None
    words = re.findall(r"[^\W\d_]+", parts[0])
    return _aliases(tuple(names.items())).get(words[0]) if words else None


def lines_of(text: str | None) -> list[str]:
    """The lines of a text that are not blank, entities resolved."""
    return [line for line in (html.unescape(x) for x in LINE_END.split(text or "")) if line.strip()]


_DIGITS = bytes(ord("0") if chr(k).isdigit() and k < 128 else k for k in range(256))


def _bytes(line: str) -> bytes:
    """A line's bytes, blanks squeezed, letters small, digits alike."""
    return " ".join(line.lower().split()).encode("utf-8", "replace").translate(_DIGITS)


def windows(lines: list[str], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all lines in windows (padded with 0), each window's line, and how many new bytes it has."""
    parts = [*map(_bytes, lines)]
    flat = np.frombuffer(b"".join(parts) + bytes(width), np.uint8)
    size = np.array([*map(len, parts)], np.int64)
    count = np.maximum(1, -(-size // width))
    line = np.repeat(np.arange(len(parts)), count)
    start = (np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)) * width
    at = np.maximum(0, np.minimum(start, size[line] - width))
    place = at[:, None] + np.arange(width)
    rows = np.where(place < size[line, None], flat[np.minimum((np.cumsum(size) - size)[line, None] + place, len(flat) - 1)], 0).astype(np.uint8)
    return rows, line, np.minimum(width, size[line] - start).astype(float)


def _highest(r: np.ndarray) -> np.ndarray:
    """The maximum over the second axis, by halves: long contiguous runs instead of many short ones."""
    while (n := r.shape[1]) > 1:
        half = n // 2
        top = np.maximum(r[:, :half], r[:, half : 2 * half])
        if n % 2:
            np.maximum(top[:, :1], r[:, -1:], out=top[:, :1])
        r = top
    return r[:, 0]


@dataclass
class ByteNetwork:
    """Embedded bytes, filters of several widths, maximum over the window, softmax over the languages ``codes``."""

    embed: int = 8
    filters: int = 16
    widths: tuple[int, ...] = (2, 3, 4, 5)
    codes: tuple[str, ...] = LANGUAGES
    names: dict[str, str] = field(default_factory=lambda: NAMES)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return len(self.codes)

    def start(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {"e": draw(256, self.embed, scale=1.0), "o": draw(self.filters * len(self.widths), self.classes, scale=0.1), "c": np.zeros(self.classes, np.float32)}
        for w in self.widths:
            self.weights |= {f"k{w}": draw(w * self.embed, self.filters, scale=1 / np.sqrt(w * self.embed)), f"b{w}": np.zeros(self.filters, np.float32)}

    def _pooled(self, x: np.ndarray, places: bool):
        e = self.weights["e"][x].reshape(len(x), -1)
        out, at = [], []
        for w in self.widths:
            n = x.shape[1] - w + 1
            spread = np.lib.stride_tricks.as_strided(e, (len(x), n, w * self.embed), (e.strides[0], e.strides[1] * self.embed, e.strides[1]))
            r = np.ascontiguousarray(spread).reshape(-1, w * self.embed) @ self.weights[f"k{w}"]
            r = r.reshape(len(x), n, self.filters)
            if places:
                at.append(r.argmax(1))
            out.append(np.maximum(_highest(r) + self.weights[f"b{w}"], 0))
        return np.hstack(out), at

    def log_probabilities(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        out = []
        for a in range(0, len(x), batch):
            z = self._pooled(x[a : a + batch], False)[0] @ self.weights["o"] + self.weights["c"]
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, self.classes), np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, at = self._pooled(x, True)
        z = h @ self.weights["o"] + self.weights["c"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = {"o": h.T @ p, "c": p.sum(0), "e": np.zeros_like(self.weights["e"])}
        back = (p @ self.weights["o"].T) * (h > 0)
        for k, w in enumerate(self.widths):
            d = back[:, k * self.filters : (k + 1) * self.filters]
            seen = x[np.arange(len(x))[:, None, None], at[k][:, :, None] + np.arange(w)]  # windows, filters, width
            patch = self.weights["e"][seen].reshape(len(x), self.filters, -1)
            g[f"k{w}"] = np.einsum("nf,nfk->kf", d, patch)
            g[f"b{w}"] = d.sum(0)
            np.add.at(g["e"], seen.ravel(), (d[:, :, None] * self.weights[f"k{w}"].T[None]).reshape(-1, self.embed))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int | None = None, seed: int = 3, batch: int = 96, rate: float = 3e-3) -> ByteNetwork:
        """Adam over shuffled windows; some windows are shortened, for short lines' sake.

        Few windows are gone through more often: 6 to 40 times, about 40 000 windows in all.
        """
        self.start(seed)
        epochs = epochs or min(40, max(6, 40_000 // max(1, len(x))))
        rng = np.random.default_rng(seed)
        y = y.copy()
        m, v, t = {k: 0.0 for k in self.weights}, {k: 0.0 for k in self.weights}, 0
        for epoch in range(epochs):
            if epoch == epochs // 2 and len(x):
                sure = self.log_probabilities(x)
                y = np.where(sure.max(1) > np.log(0.9), sure.argmax(1), y)
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                some = x[order[a : a + batch]].copy()
                for row in range(0, len(some), 3):
                    some[row, rng.integers(16, some.shape[1]) :] = 0
                t += 1
                for k, g in self._gradients(some, y[order[a : a + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    step = rate * (1 - epoch / (epochs + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.weights[k] = (self.weights[k] - step).astype(np.float32)
        return self


def fit_on(docs: DataFrame, text_column: str = "text", label_column: str = "language", id_column: str = "document_id", rows: int = SAMPLE_ROWS, per_language: int = SAMPLE_WINDOWS, names: dict[str, str] = NAMES) -> ByteNetwork:
    """A network fitted on at most ``rows`` rows whose label names a language, those of smallest hash.

    ``names`` has the codes and names of each language; the network's languages are those that labels name.
    """
    aliases = [*_aliases(tuple(names.items()))]
    first = F.regexp_extract(F.lower(F.trim(label_column)), r"^(\p{L}+)", 1)
    labelled = docs.where(first.isin(aliases) & F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("i"), F.col(text_column).alias("t"), F.col(label_column).alias("l"))
    total = labelled.count()
    # A share by hash first, so that no more than a few times ``rows`` texts are sorted.
    if total > 2 * rows:
        labelled = labelled.where(F.pmod(F.xxhash64("i", F.lit(21)), F.lit(1_000_003)) <= 1_000_003 * 2 * rows / total)
    drawn = labelled.orderBy(F.xxhash64("i", F.lit(22)), "i").limit(rows).collect()  # bounded by ``rows``
    by: dict[str, list[np.ndarray]] = {code: [] for code in names}
    have = dict.fromkeys(names, 0)
    for r in drawn:
        code = named_language(r.l, names)
        if code is None or have[code] >= per_language:
            continue
        x = windows(lines_of(r.t))[0]
        by[code].append(x)
        have[code] += len(x)
    codes = tuple(code for code in names if have[code]) or tuple(names)
    xs = [np.concatenate(by[code])[:per_language] if by[code] else np.zeros((0, WINDOW), np.uint8) for code in codes]
    most = max(1, min(per_language, max(map(len, xs))))
    rng = np.random.default_rng(1)
    xs = [x if not len(x) or len(x) >= most else x[np.concatenate([np.arange(len(x)), rng.integers(0, len(x), min(most - len(x), 4 * len(x)))])] for x in xs]
    y = np.concatenate([np.full(len(x), k) for k, x in enumerate(xs)])
    return ByteNetwork(codes=codes, names=names).fit(np.concatenate(xs), y)


def _judge(network: ByteNetwork, lines: list[str], owner: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line its language and confidence, per document its main one and confidence (-1: nothing to go by)."""
    x, line, new = windows(lines)
    logs = network.log_probabilities(x).astype(np.float64)
    total = np.zeros((len(lines), network.classes))
    np.add.at(total, line, logs * (np.maximum(new, 1) / WINDOW)[:, None])
    words = np.array([len(_WORD.findall(t)) for t in lines], float)
    letters = np.array([any(c.isalpha() for c in t) for t in lines], bool)
    share = np.exp(total - total.max(1, keepdims=True)) if len(total) else total
    share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    votes = np.zeros((documents, network.classes))
    np.add.at(votes, (owner[letters], share[letters].argmax(1)), words[letters])
    weak = np.zeros_like(votes)
    np.add.at(weak, owner[letters], share[letters] * words[letters][:, None])
    sums = weak.sum(1)
    main = np.where(sums > 0, (votes + weak * 1e-6).argmax(1), -1)
    trust = np.where(sums > 0, weak[np.arange(documents), main] / np.maximum(sums, 1e-300), 0.0)
    after = total.copy()
    has = letters & (main[owner] >= 0)
    after[np.flatnonzero(has), main[owner[has]]] += PRIOR
    found = np.where(has, after.argmax(1), main[owner])
    return found, share[np.arange(len(lines)), np.maximum(found, 0)], main, trust


def languages(docs: DataFrame, network: ByteNetwork, id_column: str = "document_id", text_column: str = "text", label_column: str = "language") -> DataFrame:
    """(document_id, line_no, lang_code, confidence, main, named): a row per document (line_no 0) and per line.

    ``line_no`` counts the lines that are not blank from 1; ``main`` is the document's main language,
    ``named`` the one its label names, or null.  Texts that are null or blank give no rows; where no letter stands, ``lang_code`` is null
    and the confidence 0; a line without letters goes with its document's main language.  Null ids are
    kept out, repeated rows give their rows again, other columns are ignored.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # some 20 kB
    kind = "document_id long, line_no int, lang_code string, confidence double, main string, named string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = sent.value
        codes = [*ours.codes, None]
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = [lines_of(t) for t in batch.column(1).to_pylist()]
                owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                lines = [x for t in texts for x in t]
                found, sure, main, trust = _judge(ours, lines, owner, len(texts))
                named = [named_language(x, ours.names) for x in batch.column(2).to_pylist()]
                number = np.concatenate([np.arange(1, len(t) + 1) for t in texts] or [np.empty(0)])
                some = np.array([k for k, t in enumerate(texts) if t], np.int64)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[some], ids[owner]]), pa.int64()),
                        pa.array(np.concatenate([np.zeros(len(some)), number]).astype(np.int32)),
                        pa.array([codes[k] for k in [*main[some], *found]], pa.string()),
                        pa.array(np.concatenate([trust[some], np.where(found >= 0, sure, 0.0)])),
                        pa.array([codes[main[k]] for k in [*some, *owner]], pa.string()),
                        pa.array([named[k] for k in [*some, *owner]], pa.string()),
                    ],
                    ["document_id", "line_no", "lang_code", "confidence", "main", "named"],
                )

    rows = docs.select(F.col(id_column).cast("long").alias("document_id"), F.col(text_column).alias("text"), F.col(label_column).alias("label")).where("document_id is not null and text is not null")
    return rows.mapInArrow(run, kind)


def corrections(found: DataFrame) -> DataFrame:
    """(document_id, line_no, lang_code): documents whose label is missing or wrong (line 0), and foreign lines."""
    wrong = F.col("named").isNull() | (F.col("named") != F.col("main"))
    foreign = F.col("lang_code") != F.col("main")
    return found.where(F.col("lang_code").isNotNull() & F.when(F.col("line_no") == 0, wrong).otherwise(foreign)).select("document_id", "line_no", "lang_code")
