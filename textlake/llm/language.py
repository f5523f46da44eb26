"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.blocks import chunks, mix, narrow_batches, release, runs

ORDER = 5
#: Documents of each language that a model learns from; more are drawn by a hash of doc_id.
TRAIN_DOCS = 1000
#: A language with fewer different held-out texts is not calibrated: all its texts are accepted.
MIN_HELD = 4
#: Bytes of text that are judged at once: each takes some 50 bytes of hashes.
TEXT_BYTES = 512 << 10
_PAD = "\U0010FFFF"
_FACTOR = 0x9DDFEA08EB382D69
_codes: list[np.ndarray] = []


def _lookup() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 32 for anything else, 0 for the pad."""
    if not _codes:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x20000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        table[0x20000:0x32000] = np.arange(0x20000, 0x32000)
        table[ord(_PAD)] = 0
        _codes.append(table)
    return _codes[0]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, text number of each code, letters of each text).

    Runs of other characters are one space; a text is led by pads and a space, so that no
    n-gram reaches into the text before it.
    """
    joined = "".join(_PAD * (ORDER - 1) + " " + t for t in texts)
    code = _lookup()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    sizes = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    gap = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    code, doc = code[keep], doc[keep]
    return code, doc, np.bincount(doc[(code != 32) & (code != 0)], minlength=len(texts))


def ngram_hashes(code: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 .. order: the hash of the n codes that end at each place."""
    unit = mix(code.astype(np.uint64) + np.uint64(1))
    out, factor = [unit], 1
    for n in range(2, order + 1):
        factor = factor * _FACTOR % (1 << 64)
        value = out[-1].copy()
        value[n - 1:] += unit[:len(unit) - n + 1] * np.uint64(factor)
        out.append(value)
    return out


@dataclass
class Model:
    """Sorted hash arrays for each order: n-grams with their discounted share, contexts with their
    back-off share, a column per language; and the calibration of each language."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    uniform: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = 6.0

    def log_probs(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Natural log probability of the code at each place, a column per language."""
        p = np.full((len(at), len(self.langs)), self.uniform, np.float32)
        for n in range(1, ORDER + 1):
            table, share = self.grams[n - 1]
            context, rest = self.contexts[n - 1]
            if n > 1:
                got, i = _find(context, hashes[n - 2][at - 1])
                p[got] *= rest[i]
            else:
                p *= rest[0]
            got, i = _find(table, hashes[n - 1][at])
            p[got] += share[i]
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per code and language, scored codes, letters) of each text."""
        code, doc, n_letters = letters(texts)
        hashes = ngram_hashes(code, ORDER)
        live = np.flatnonzero(code != 0)
        _, first, back = np.unique(hashes[-1][live], return_index=True, return_inverse=True)
        logs = self.log_probs(hashes, live[first])
        n = np.bincount(doc[live], minlength=len(texts))
        sums = np.stack([np.bincount(doc[live], weights=logs[:, k][back], minlength=len(texts)) for k in range(len(self.langs))], 1)
        return -sums / np.maximum(n, 1)[:, None], n, n_letters

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, accepted) of each text."""
        h, n, n_letters = self.entropies(texts)
        best = np.argmin(h, 1)
        low = h[np.arange(len(texts)), best]
        score = 1 / np.exp(ORDER * (low[:, None] - h)).sum(1)
        z = (low - self.mean[best]) / np.sqrt(self.spread[best, 0] ** 2 + self.spread[best, 1] ** 2 / np.maximum(n, 1))
        known = n_letters > 0
        return np.where(known, best, -1), np.where(known, score, 0.0), known & (z <= self.limit)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the keys that the sorted table has, their rows)."""
    i = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    got = np.flatnonzero(table[i] == keys) if len(table) else np.zeros(0, np.int64)
    return got, i[got]


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Kneser-Ney tables of one language for each order: (n-grams, shares, contexts, back-off shares)."""
    code, _, _ = letters(texts)
    hashes = ngram_hashes(code, ORDER)
    live = np.flatnonzero(code != 0)
    _, at, count = np.unique(hashes[-1][live], return_index=True, return_counts=True)
    at = live[at]
    out = []
    for n in range(ORDER, 0, -1):
        gram = hashes[n - 1][at]
        context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        order = np.argsort(context, kind="stable")
        starts = runs(context[order])[:-1]
        total = np.add.reduceat(count[order].astype(np.float64), starts)
        kinds = np.diff(np.append(starts, len(at)))
        group = np.empty(len(at), np.int64)
        group[order] = np.repeat(np.arange(len(starts)), kinds)
        out.append((gram, (count - discount) / total[group], context[order][starts], discount * kinds / total))
        if n > 1:  # the lower order counts the distinct n-grams that extend it to the left
            _, pick, count = np.unique(hashes[n - 2][at], return_index=True, return_counts=True)
            at = at[pick]
    return out[::-1]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]], default: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([k for k, _ in parts]))
    values = np.full((len(keys), len(parts)), default, np.float32)
    for column, (k, v) in enumerate(parts):
        values[np.searchsorted(keys, k), column] = v
    return keys, values


def _left_out(texts: list[str], uniform: float) -> tuple[np.ndarray, np.ndarray]:
    """(entropy, scored codes) of each different text that has letters, by a fit on the texts that differ from it."""
    own, size = [], []
    for text in dict.fromkeys(texts):
        rest = [t for t in texts if t != text]
        if not rest:
            continue
        model = Model([""], uniform=uniform)
        for gram, share, context, back in _counts(rest):
            model.grams.append(_merged([(gram, share)], 0.0))
            model.contexts.append(_merged([(context, back)], 1.0))
        h, n, n_letters = model.entropies([text])
        if n_letters[0]:
            own.append(h[0, 0])
            size.append(n[0])
    return np.array(own), np.array(size, np.int64)


def train(docs: DataFrame, learn: Column | None = None, per_lang: int = TRAIN_DOCS) -> Model | None:
    """Learn the languages of ``docs`` (``doc_id``, ``text``, ``lang``) where ``learn`` holds.

    About ``per_lang`` documents of each language are drawn by a hash of doc_id; four of five
    make the counts, the others calibrate the rejection. With fewer than 20, all make the counts, and each text
    is measured for the calibration by a fit on the others. None without a labelled text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    known = known if learn is None else known.where(learn)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = (known.where(draw < F.element_at(rate, F.col("lang")))
             .select("lang", "text", F.coalesce(F.col("doc_id"), F.lit(0)).alias("doc_id")).collect())
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in drawn:
        texts.setdefault(r["lang"], []).append((r["doc_id"], r["text"]))
    model = Model(sorted(texts))
    fit, test = {}, {}
    for lang in model.langs:
        ordered = [t for _, t in sorted(texts[lang])]
        test[lang] = ordered[::5] if len(ordered) >= 20 else None
        fit[lang] = [t for i, t in enumerate(ordered) if i % 5] if len(ordered) >= 20 else ordered
    tables = [_counts(fit[lang]) for lang in model.langs]
    for n in range(ORDER):
        model.grams.append(_merged([t[n][:2] for t in tables], 0.0))
        model.contexts.append(_merged([t[n][2:] for t in tables], 1.0))
    model.uniform = 1.0 / (len(model.grams[0][0]) + 1)
    mean, spread = [], []
    for k, lang in enumerate(model.langs):
        if test[lang] is None:
            own, n = _left_out(fit[lang], model.uniform)
            if len(own) < MIN_HELD:
                mean.append(0.0)
                spread.append((np.inf, 1.0))
                continue
        else:
            h, n, n_letters = model.entropies(test[lang])
            own, n = h[n_letters > 0, k], n[n_letters > 0]
        mean.append(np.median(own) if len(own) else 0.0)
        off = np.abs(own - mean[-1]) if len(own) else np.ones(1)
        long = n >= np.median(n) if len(own) else np.ones(1, bool)
        spread.append((max(1.4826 * np.median(off[long]), 0.1), max(np.sqrt(np.mean(off ** 2 * np.maximum(n, 1))) if len(own) else 1.0, 1.0)))
    model.mean, model.spread = np.array(mean), np.array(spread)
    return model


def identify(docs: DataFrame, model: Model | None, keep: bool = False, prefix: str = "_") -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score, accepted``.

    ``lang_pred`` has the lowest cross-entropy per character; it is ``und`` with score 0 for a text
    that is null or has no letter, and for all texts when nothing was learned. ``accepted`` is false for
    ``und`` and where the cross-entropy is out of the range calibrated for texts of that length.
    With ``keep``, all columns of ``docs`` stay and three are added, their names led by ``prefix``; see ``blocks.free_prefix``.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [(prefix if keep else "") + n for n in ("lang_pred", "score", "accepted")]
    source = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = docs.columns if keep else ["doc_id"]

    def run(batches):
        release()
        learned = shared.value
        for batch in chunks(batches, limit=TEXT_BYTES):
            n = batch.num_rows
            pred, score, accepted = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            if learned:
                pred, score, accepted = learned.judge([t or "" for t in batch.column("text").to_pylist()])
            langs = ["und" if k < 0 else learned.langs[k] for k in pred.tolist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(langs, pa.string()), pa.array(score), pa.array(accepted)],
                                             [*kept, *names])
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c in kept)
    return source.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` boolean")
