"""Operator 5: a ledger of quality rules as bit masks.

Every rule is evaluated once for each text.  The ledger stores the measurements and a mask whose bits
say which rules failed.  A policy is a version and the bits that reject; changing it, or asking what each
rule contributes, reads the ledger only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.textvec import Prefix, Words, blocks, sized

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts")

#: Bit of each rule, and when it fails.  Whole-number comparisons, so that any engine agrees.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (1, "n_words < 10"),
    "repeated_windows": (2, "100 * n_repeat_words > 20 * n_words"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (8, "word_chars > 20 * n_words"),
    "symbols": (16, "100 * n_symbols > 10 * n_words"),
    "repeated_lines": (32, "100 * n_dup_lines > 30 * n_lines"),
    "capitals": (64, "n_upper > n_lower"),
    "exclamations": (128, "100 * n_shouts > 30 * n_words"),
}
BASE_BITS = 1 | 2
#: Versioned policies: the bits that reject a document.
POLICIES: dict[str, int] = {"v1": BASE_BITS, "v2": 255}


def _repeat_words(words: Words, n: int = 5) -> np.ndarray:
    at, h = words.windows(n)
    text = words.text[at]
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    delta = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(delta, at[twice], 1)
    np.add.at(delta, at[twice] + n, -1)
    return np.bincount(words.text[np.cumsum(delta)[:-1] > 0], minlength=words.n_texts)


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one, for each text."""
    stop = (words.buf == 0x0A).copy()
    stop[words.text_start[1:] - 1] = True
    end = np.flatnonzero(stop)
    start = np.concatenate([[0], end[:-1] + 1])
    text = np.searchsorted(words.text_start, start, side="right") - 1
    has = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end, text = start[has], end[has], text[has]
    h = Prefix(words.buf).of(start, end)
    order = np.lexsort((np.arange(len(h)), h, text))
    dup = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    return np.bincount(text, minlength=words.n_texts), np.bincount(text[order[1:][dup]], minlength=words.n_texts)


def _measures(batches):
    import pyarrow as pa

    symbol, upper, lower = (np.zeros(256, dtype=bool) for _ in range(3))
    symbol[list(b"#*$%&|<>")] = True
    upper[0x41:0x5B] = True
    lower[0x61:0x7B] = True
    for batch in batches:
        rest = [f.name for f in batch.schema if f.name != "text"]
        for at, texts in blocks(batch):
            w = Words(texts)
            sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[w.text_start])
            heads = (w.buf & 0xC0) != 0x80
            total = np.concatenate([[0], np.cumsum(heads)])
            chars = np.bincount(w.text, total[w.end] - total[w.start], w.n_texts).astype(np.int64)
            shout = (w.end - w.start >= 2) & (w.buf[w.end - 1] == 0x21) & (w.buf[np.maximum(w.end - 2, 0)] == 0x21)
            n_lines, n_dup = _lines(w)
            cols = {n: batch.column(batch.schema.get_field_index(n)).slice(at, len(texts)) for n in rest}
            values = (w.count, chars, sums(symbol[w.buf]), n_dup, _repeat_words(w), n_lines, sums(upper[w.buf]), sums(lower[w.buf]), np.bincount(w.text[shout], minlength=w.n_texts))
            cols |= {n: pa.array(np.asarray(v, dtype=np.int64)) for n, v in zip(MEASURES, values)}
            yield pa.RecordBatch.from_pydict(cols)


def mask_column() -> Column:
    """The failed rules' bits, from the measurements."""
    bits = [F.when(F.expr(rule), F.lit(bit)).otherwise(0) for bit, rule in RULES.values()]
    mask: Column = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask.cast("int")


def rule_ledger(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, the measurements, and ``mask`` (int).

    A null or blank text has no words: all its measurements are 0 and it fails ``few_words`` alone.
    Repeated rows and null ids give a row each; other columns are not read.  No row depends on another.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sized(docs).select("doc_id", "text").mapInArrow(_measures, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("mask", mask_column())


def judged(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    rejects = POLICIES[policy] | BASE_BITS
    return ledger.withColumn("base_failed", F.col("mask").bitwiseAND(BASE_BITS) != 0).withColumn("kept", F.col("mask").bitwiseAND(rejects) == 0)


def passing(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns; no shuffle."""
    rows = sized(docs).select(F.struct("*").alias("row"), "text").mapInArrow(_measures, f"row {_quoted(docs)}, " + ", ".join(f"{m} long" for m in MEASURES))
    return judged(rows.withColumn("mask", mask_column()), policy).filter("kept").select("row.*")


def _quoted(docs: DataFrame) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema) + ">"


def ablation(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule of a policy: (rule, bit, failed, only) - documents that fail it, and those that would
    be kept without it.  One pass with partial sums; a mask is folded before the shuffle."""
    bits = POLICIES[policy]
    by_mask = ledger.groupBy(F.col("mask").bitwiseAND(bits).alias("m")).agg(F.count("*").alias("n"))
    rules = [(name, bit) for name, (bit, _) in RULES.items() if bit & bits]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in rules))).alias("r")
    return (
        by_mask.select("m", "n", each)
        .groupBy("r.rule", "r.bit")
        .agg(
            F.sum(F.when(F.expr("m & r.bit") != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.expr("m = r.bit"), F.col("n")).otherwise(0)).alias("only"),
        )
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
  len(list_filter(ws, lambda x: x LIKE '%!!'))::BIGINT AS n_shouts
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lin USING (doc_id)),
b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 20 * n_words)::INT
  + 16 * (100 * n_symbols > 10 * n_words)::INT + 32 * (100 * n_dup_lines > 30 * n_lines)::INT + 64 * (n_upper > n_lower)::INT + 128 * (100 * n_shouts > 30 * n_words)::INT) AS mask FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (mask & 3) <> 0 AS base_failed, mask = 0 AS kept, mask::INT AS mask FROM b
"""
