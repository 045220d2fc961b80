"""Operator 6: personal data, and words that give it away.

Four kinds of values are found by pattern.  A value is a protected entity.  Taking values out is not
enough where a word of the same document occurs with nobody else, so the corpus is asked: for a term t in
documents of entity e, the pointwise mutual information ``log2(p(e | t) * N / n(e))`` over documents is
compared with the information of the entity itself, ``log2(N / n(e))``.  ``p(e | t)`` is estimated as
``n(t, e) / (n(t) + PRIOR)``, so a term seen once tells less than one seen often, and entities and terms of
any count are judged.  A term that gives away a share of the information above :data:`REMOVE` is removed, above
:data:`GENERALISE` it is replaced by its shape.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlens.llm.textvec import blocks, sized
from tenderlens.plans.staging import materialize, small

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information that a term may give away.
GENERALISE, REMOVE = 0.8, 0.95
#: Documents without the entity that a term is thought to be in besides those counted.
PRIOR = 0.5
#: The table of disclosing words by text is broadcast up to so many texts and words (about 32 bytes each).
TOLD_ROWS, TOLD_TERMS = 60_000, 1_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_PARTS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each '@' with the run of local characters before it: what the pattern matches, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCALS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DOTTED.finditer(text):
        parts = list(_PARTS.finditer(text, run.start(), run.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or "0") <= 255 for p in four):
                out.append((four[0].start(), four[3].end()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if any(d in text for d in "0123456789"):
        out += [(a, 1, b) for a, b in _ips(text)]
        out += [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in _phones(text)]
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """How a value is told apart: by digits, or in lower case."""
    return f"{KINDS[kind]}:" + (value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _term(word: str) -> str:
    return word.strip(".,;:!?()[]\"'").lower()


def _apart(text: str, spans) -> list[tuple[int, int, str]]:
    """(start, end, term) of the words of a text that no value reaches into."""
    taken: list[list[int]] = []  # the values' extent, merged
    for a, _, b in spans:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    heads = [a for a, _ in taken]
    out = []
    for m in _WORD.finditer(text):
        s, e = m.span()
        core = m[0].strip(".,;:!?()[]\"'")
        last = bisect_left(heads, e) - 1
        if core and (last < 0 or taken[last][1] <= s):
            s += m[0].index(core)
            out.append((s, s + len(core), core.lower()))
    return out


def term_key(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _decoded(batch):
    """The texts of a batch one after another, null as empty."""
    for _, part in blocks(batch):
        for t in part:
            yield t.decode("utf-8", "replace")


def _mentions(batches):
    """The entities of each document that has some, and its terms."""
    import pyarrow as pa

    for batch in batches:
        rows = batch.column(batch.schema.get_field_index("row")).to_pylist()
        out: list[tuple[int, bool, int]] = []  # copies count each, so no set over documents
        for row, text in zip(rows, _decoded(batch)):
            if not text or not ("@" in text or any(d in text for d in "0123456789")):
                continue
            spans = base_spans(text)
            if spans:
                out += {(row, True, term_key(entity(k, text[a:b]))) for a, k, b in spans}
                out += [(row, False, term_key(t)) for t in {t for _, _, t in _apart(text, spans)}]
        cols = list(zip(*out)) if out else [[], [], []]
        types = {"row": pa.int64(), "is_entity": pa.bool_(), "key": pa.int64()}
        yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(types.items(), cols)})


def _term_rows(batches):
    """(term, texts of the block that hold it): summed within a block of texts before the shuffle."""
    import pyarrow as pa

    cache: dict[bytes, int] = {}
    for batch in batches:
        total: dict[int, int] = {}
        for t in (t for _, part in blocks(batch) for t in part):
            seen = set()
            for word in set(t.split()):
                k = cache.get(word)
                if k is None:
                    core = _term(word.decode("utf-8", "replace"))
                    k = term_key(core) if core else 0
                    if len(cache) < 300_000:
                        cache[word] = k
                seen.add(k)
            for k in seen:
                total[k] = total.get(k, 0) + 1
        total.pop(0, None)
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """(row, terms): for a text with values (``row`` is its xxhash64), the keys of its words that disclose
    one of them, with the share of the information they give away.  ``docs`` has ``row`` and ``text``; every
    row of it is a document of its own in all counts."""
    seen = docs.mapInArrow(_mentions, "row long, is_entity boolean, key long").groupBy("row", "is_entity", "key").agg(F.count("*").alias("n"))
    seen = materialize(seen, "op6seen")  # equal texts are one row from here on
    n = float(max(1, docs.count()))
    n_entity = materialize(seen.filter("is_entity").groupBy(F.col("key").alias("entity")).agg(F.sum("n").alias("n_e")).filter(F.col("n_e") < n), "op6ent")
    most = n_entity.agg(F.max("n_e")).first()[0] or 0

    def reach(n_e):
        """No term in more documents can reach the share, as n(t, e) <= n(e); a little over, for rounding."""
        return F.pow(n_e / F.lit(n), F.lit(1 - generalise)) ** -1 * n_e * (1 + 1e-9) - PRIOR

    wanted = materialize(seen.filter("not is_entity").select(F.col("key").alias("term")).distinct(), "op6term")
    n_term = docs.select("text").mapInArrow(_term_rows, "term long, n long").join(small(wanted), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_t"))
    n_term = materialize(n_term.filter(F.col("n_t") <= reach(F.lit(float(most)))), "op6nt")
    entities = seen.filter("is_entity").select("row", F.col("key").alias("entity")).join(small(n_entity), "entity")
    terms = seen.filter("not is_entity").select("row", F.col("key").alias("term"), "n").join(small(n_term), "term")
    met = materialize(terms.join(entities, "row").filter(F.col("n_t") <= reach(F.col("n_e"))), "op6met")
    pairs = met.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    pmi = F.log2(F.col("n_te") / (F.col("n_t") + PRIOR) * n / F.col("n_e"))
    share = pmi / F.log2(F.lit(n) / F.col("n_e"))
    told = pairs.withColumn("share", share).filter(F.col("share") >= generalise).select("entity", "term", "share")
    found = met.select("row", "entity", "term").join(told, ["entity", "term"]).groupBy("row", "term").agg(F.max("share").alias("share"))
    return found.groupBy("row").agg(F.collect_list(F.struct("term", "share")).alias("terms"))


def _spans(batches):
    import pyarrow as pa

    for batch in batches:
        rest = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name not in ("text", "terms")}
        told = batch.column(batch.schema.get_field_index("terms"))
        out = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base", "spans", "clean")}
        for n, text in enumerate(_decoded(batch)):
            spans = base_spans(text)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(s[1] == k for s in spans))
            base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            share = {x["term"]: max(x["share"], 0) for x in told[n].as_py() or ()} if spans else {}
            extra = {(a, 4 + (share[term_key(t)] >= REMOVE), b) for a, b, t in _apart(text, spans) if term_key(t) in share} if share else set()
            every = sorted(set(spans) | extra)
            out["base"].append(hashlib.sha256(base.encode()).hexdigest())
            out["spans"].append(",".join(f"{(*KINDS, 'shape', 'term')[k]}:{a}:{b}" for a, k, b in every))
            clean, at = [], 0
            for a, k, b in every:
                if a < at:
                    at = max(at, b)
                    continue
                word = text[a:b]
                clean += [text[at:a], "[" + KINDS[k] + "]" if k < 4 else re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "x", word)) if k == 4 else "[term]"]
                at = b
            out["clean"].append("".join([*clean, text[at:]]))
        yield pa.RecordBatch.from_pydict(rest | {k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items()})


def sanitised(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, ``n_email n_ip n_card n_phone``, ``base``
    (SHA-256 of the base spans), ``spans`` (all spans), ``clean`` (the text with values masked, disclosing
    words removed or generalised).

    A null text is empty and has no spans.  Repeated rows are documents of their own and count as such.
    Values of different kinds may overlap; the text is masked at the first.  A text without values is
    returned unchanged.  Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sized(docs).select("doc_id", "text", F.xxhash64("text").alias("row"))
    told = materialize(disclosing_terms(rows.select("row", "text")), "op6told")
    n, terms = told.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    joined = rows.join(F.broadcast(told) if n <= TOLD_ROWS and terms <= TOLD_TERMS else told, "row", "left").select("doc_id", "text", "terms")
    return joined.mapInArrow(_spans, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, clean string")
