"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of ``SEGMENT`` bytes.  A gated recurrent unit reads
each segment forwards, another one backwards; from both states every byte gets
probabilities of all languages.  A document's probabilities are the means over
its letter bytes.  Gates are piecewise linear (hard sigmoid, clipped candidate),
which numpy evaluates for thousands of segments at once.  Training is plain
numpy: backpropagation through time and Adam, from a fixed seed, on the driver.

Trained on at most ``per_lang`` windows of ``WINDOW`` characters per language,
cut at pseudo-random places of pseudo-randomly drawn documents; scored texts are
read whole.  Null texts and texts without a letter are ``und`` with score 0.  When
no labelled text is left to learn from, every text is ``und``.  Rows are judged one
by one, so repeated rows agree and extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import pieces

UNKNOWN = "und"
SEGMENT = 64
WINDOW = 256
PER_LANG = 400
HIDDEN = 8
STEPS = 200
BATCH = 256
_AT_ONCE = 2_048  # segments

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True

Weights = dict[str, np.ndarray]


class Model(NamedTuple):
    languages: list[str]
    weights: Weights


def start_weights(languages: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"out": draw(0.3, languages, 2 * hidden), "bias": np.zeros((languages, 1), np.float32)}
    for way in "fb":
        w |= {f"{way}_byte": draw(0.5, 3 * hidden, 256), f"{way}_state": draw(hidden**-0.5, 3 * hidden, hidden)}
        w[f"{way}_byte"][:hidden] += 1.0  # gates start by keeping the state
    return w


def _read(byte: np.ndarray, state: np.ndarray, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States after each step of ``x`` (steps x segments), and what training needs."""
    hidden = state.shape[1]
    h = np.zeros((hidden, x.shape[1]), np.float32)
    states, tape = np.empty((len(x), hidden, x.shape[1]), np.float32), []
    for t, step in enumerate(x):
        a, g = byte.take(step, axis=1), state @ h
        gates, candidate = a[: 2 * hidden], a[2 * hidden :]
        gates += g[: 2 * hidden]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:hidden], gates[hidden:]
        candidate += r * g[2 * hidden :]
        np.clip(candidate, -1, 1, out=candidate)
        if keep:
            tape.append((h.copy(), z, r, candidate, g[2 * hidden :]))
        h -= candidate
        h *= z
        h += candidate
        states[t] = h
    return states, tape


def _unread(state: np.ndarray, tape: list, x: np.ndarray, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and the state matrix."""
    hidden = state.shape[1]
    d_state, d_byte = np.zeros_like(state), np.empty((len(x), x.shape[1], 3 * hidden), np.float32)
    dh = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        before, z, r, c, g = tape[t]
        dh = dh + d_states[t]
        dc = dh * (1 - z) * (np.abs(c) < 1)
        dz = dh * (before - c) * 0.25 * ((z > 0) & (z < 1))
        dr = dc * g * 0.25 * ((r > 0) & (r < 1))
        dg = np.concatenate([dz, dr, dc * r])
        d_byte[t] = np.concatenate([dz, dr, dc]).T
        d_state += dg @ before.T
        dh = dh * z + state.T @ dg
    table = np.zeros((256, 3 * hidden), np.float32)
    np.add.at(table, x.ravel(), d_byte.reshape(-1, 3 * hidden))
    return table.T, d_state


def byte_probabilities(w: Weights, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
    """Probabilities (steps x languages x segments) of every byte of ``x`` (steps x segments)."""
    forward, f_tape = _read(w["f_byte"], w["f_state"], x, keep)
    backward, b_tape = _read(w["b_byte"], w["b_state"], x[::-1], keep)
    both = np.concatenate([forward, backward[::-1]], axis=1)
    p = w["out"] @ both + w["bias"]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p, (both, f_tape, b_tape)


def gradients(w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean cross-entropy over letter bytes, and its gradients."""
    p, (both, f_tape, b_tape) = byte_probabilities(w, x, True)
    counted = _LETTER[x]
    n = max(1, counted.sum())
    loss = -float((np.log(np.take_along_axis(p, y[None, None, :], 1)[:, 0] + 1e-9) * counted).sum() / n)
    d = p.copy()
    np.put_along_axis(d, y[None, None, :], np.take_along_axis(d, y[None, None, :], 1) - 1, 1)
    d *= (counted / n)[:, None, :].astype(np.float32)
    hidden = w["f_state"].shape[1]
    g = {"out": np.einsum("tcb,thb->ch", d, both, optimize=True), "bias": d.sum(axis=(0, 2))[:, None]}
    d_both = w["out"].T @ d
    g["f_byte"], g["f_state"] = _unread(w["f_state"], f_tape, x, d_both[:, :hidden])
    g["b_byte"], g["b_state"] = _unread(w["b_state"], b_tape, x[::-1], d_both[::-1, hidden:])
    return loss, g


def segments(data: bytes) -> np.ndarray:
    """Rows of ``SEGMENT`` bytes, the last one filled with zeros."""
    raw = np.frombuffer(data, np.uint8)
    rows = -(-len(raw) // SEGMENT)
    return np.pad(raw, (0, rows * SEGMENT - len(raw))).reshape(rows, SEGMENT)


def train(examples: list[tuple[str, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 11) -> Model:
    """Fit to (text, language) examples."""
    languages = sorted({lang for _, lang in examples})
    if not languages:
        return Model([], {})
    parts = [(segments(text.encode().lower()), languages.index(lang)) for text, lang in examples]
    x = np.concatenate([p for p, _ in parts])
    y = np.repeat([k for _, k in parts], [len(p) for p, _ in parts])
    full = _LETTER[x].sum(axis=1) > SEGMENT // 4
    x, y = (x[full], y[full]) if full.any() else (x, y)
    w, rng = start_weights(len(languages), hidden, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    by_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    by_class = [c for c in by_class if len(c)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, -(-BATCH // len(by_class))) for c in by_class])
        _, g = gradients(w, np.ascontiguousarray(x[pick].T), y[pick])
        norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
        rate = 0.02 * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, a in g.items():
            a = a * min(1.0, 1.0 / max(norm, 1e-12))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


def training_windows(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """(text window, language) of at most ``per_lang`` documents per language of (doc_id, text, lang)."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return []
    # A share of each language by hash: about 1.2 times the wanted number, cut to it on the driver.
    top = 1 << 32
    h = F.xxhash64(F.lit("langid"), "doc_id", "text")
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(top, int(top * (1.2 * per_lang + 20) / n)))])
    drawn = usable.withColumn("h", h).filter(F.pmod("h", F.lit(top)) < F.element_at(share, F.col("lang")))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    rows = drawn.select("h", "lang", F.col("text").substr(place, F.lit(WINDOW)).alias("part")).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r["h"], r["part"])):
        if taken[r["lang"]] < per_lang:
            taken[r["lang"]] += 1
            out.append((r["part"], r["lang"]))
    return out


def pooled(model: Model, texts: list[str | None]) -> np.ndarray:
    """Mean probabilities of the languages over the letter bytes of each text."""
    sums, held, owners = np.zeros((len(texts), len(model.languages))), [], []

    def flush() -> None:
        x = np.ascontiguousarray(np.concatenate(held).T)
        p, _ = byte_probabilities(model.weights, x)
        np.add.at(sums, np.concatenate(owners), np.einsum("tcb,tb->bc", p, _LETTER[x].astype(np.float32)))
        held.clear(), owners.clear()

    waiting = 0
    for n, text in enumerate(texts):
        rows = segments((text or "").encode().lower())
        for at in range(0, len(rows), _AT_ONCE):
            part = rows[at : at + _AT_ONCE]
            held.append(part), owners.append(np.full(len(part), n))
            waiting += len(part)
            if waiting >= _AT_ONCE:
                flush()
                waiting = 0
    if held:
        flush()
    total = sums.sum(axis=1, keepdims=True)
    return sums / np.where(total > 0, total, 1)


def language(text: Column, model: Model) -> Column:
    """Struct (lang, score) of a text."""

    @F.arrow_udf("lang string, score double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            best, score = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for at, texts in pieces(batch):
                p = pooled(model, texts)
                part = slice(at, at + len(texts))
                best[part], score[part] = p.argmax(axis=1), p.max(axis=1)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score)], ["lang", "score"])

    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if not model.languages:
        return unknown
    # Python functions are evaluated before a CASE; texts without letters cost nothing as they go in as null.
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return F.when(lettered, of(F.when(lettered, text))).otherwise(unknown)


def byte_labels(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Runs (first byte, end, language) of the letter bytes' labels over one text."""
    data = text.encode()
    x = segments(data.lower())
    if not len(x) or not model.languages:
        return []
    p, _ = byte_probabilities(model.weights, np.ascontiguousarray(x.T))
    label = p.argmax(axis=1).T.ravel()[: len(data)]
    at = np.flatnonzero(_LETTER[np.frombuffer(data, np.uint8)])
    cuts = np.flatnonzero(np.diff(label[at])) + 1
    return [(int(run[0]), int(run[-1]) + 1, model.languages[label[run[0]]]) for run in np.split(at, cuts) if len(run)]
