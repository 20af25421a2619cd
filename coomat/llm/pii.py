"""Operator 6: personal data, and terms that give protected entities away.

Protected entities are found by fixed patterns (email, ip, card, phone) and, besides, secrets: quoted long random
values that are assigned to a name.  Around each entity the REACH words on each side, of any length, are its terms.  Over the whole
corpus it is counted how often a term stands near an entity e and in how many documents it stands at all.  Knowing the
term t discloses of e

    ratio = log(n(e,t) N / (n(e) n(t))) / log(N / n(e))

of its information.  Single values seldom recur, so entities are counted on two levels, each value as itself and as the
group that it belongs to: an address's mail domain, an ip's block of three parts, a card's issuer, a phone's area.
The measure is pointwise mutual information over information content.  A term is generalised in the documents
that hold e, if the ratio reaches ``disclosure`` and at least SUPPORT different documents and SUPPORT different contexts
show e and t together.  A context is the run of words around e that has t in it and at least NEAR words on each side:
copies of one passage are one context, which shows the passage, not an association.

All counts are grouped sums over all documents, equal texts once.  Term counts are made only for terms that stand near
an entity often enough and aren't already in too many documents with entities for the ratio: a filter of fixed size
picks them while texts are read, and an exact join decides.  With more than some 2**20 such terms the filter lets others
pass too; then more (term, text) pairs are shuffled, at worst those of all words, and the counts stay exact.

Defined cases: a null text has no spans; a null doc_id is carried; repeated rows get equal spans and count once;
offsets are in code points, ends exclusive; spans of one kind never overlap, and terms never lie in another span;
other columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coomat.llm import kernels as K
from coomat.llm.tables import aside, filter_bits, maybe_in, membership, only, settled

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE_KINDS = 4
REACH = 8
SUPPORT = 3
NEAR = 4
DISCLOSURE = 0.8

#: Fixed patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"[=:]\s?([\"'])([A-Za-z0-9+/_-]{20,}+={0,2}+)\1")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, without trying every letter as a start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _random(value: str) -> bool:
    """A value of letters and digits mixed, with many different characters."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value.lower())) >= 8


def _named(text: str, end: int) -> bool:
    """Whether a name stands before a place: a letter or underscore that starts a word, and what may follow in a name.

    The characters of a name have no mark of assignment among them, so no stretch is read for two places.
    """
    if end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and text[start - 1] in _NAME:
        start -= 1
        c = text[start]
        if (c == "_" or c.isalpha()) and not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            return True
    return False


class Covered:
    """Spans merged into stretches, to ask whether another span meets any."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def entities(text: str) -> list[tuple[int, int, int]]:
    """Base spans and secrets."""
    out, at = base_spans(text), 0
    while "=" in text or ":" in text:
        m = _SECRET.search(text, at)
        if m is None:
            break
        if _named(text, m.start()):
            at = m.end()
            if _random(m[2]):
                out.append((4, m.start(2), m.end(2)))
        else:
            at = m.start() + 1
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def entity_key(text: str, span: tuple[int, int, int]) -> int:
    kind, start, end = span
    value = text[start:end].lower()
    return _hash(KINDS[kind], re.sub(r"[^0-9]", "", value) if kind in (2, 3) else value)


#: How many digits of a card tell its issuer, and of a phone its country and area.
ISSUER, AREA = 6, 5


def group_key(text: str, span: tuple[int, int, int]) -> int | None:
    """The group of an entity, as a key; secrets have none."""
    kind, start, end = span
    value = text[start:end].lower()
    digits = "".join(c for c in value if c.isdigit())
    of = {0: ("domain", value.rpartition("@")[2]), 1: ("block", value.rpartition(".")[0]), 2: ("issuer", digits[:ISSUER]), 3: ("area", digits[:AREA])}
    return _hash(*of[kind]) if kind in of else None


def term_hashes(words: list[str]) -> np.ndarray:
    """The hashes of words, each one run of letters and digits, in any case; the kernel gives the same over texts."""
    sep, value = K.byte_table(letters_only=True)
    data, offs = K.text_bytes(pc.utf8_lower(pa.array(words, pa.string())))
    return K.word_hashes(data, offs[:-1], offs[1:], value).view(np.int64) if len(words) else np.zeros(0, np.int64)


def words_before(text: str, end: int) -> list[re.Match]:
    """The last REACH words before a place; the stretch that is searched doubles until it has them all."""
    size = 64 * REACH
    while True:
        lo = max(0, end - size)
        found = [m for m in _WORD.finditer(text, lo, end) if lo == 0 or m.start() > lo]
        if lo == 0 or len(found) >= REACH:
            return found[-REACH:]
        size *= 4


def neighbours(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[str, int]]]]:
    """For each span its entity, and its group, with the words within REACH words, none of them inside a span, and their contexts."""
    covered, out = Covered(spans), []
    for span in spans:
        _, start, end = span
        before, after = words_before(text, start), list(islice(_WORD.finditer(text, end), REACH))
        before, after = ([m[0] for m in side if not covered.meets(*m.span())] for side in (before[::-1], after))
        low = [[w.lower() for w in side] for side in (before, after)]
        runs = {(i, j): _hash(*low[0][:i], "", *low[1][:j]) for i, j in {(NEAR, NEAR), *((i, NEAR) for i in range(NEAR, len(before) + 1)), *((NEAR, j) for j in range(NEAR, len(after) + 1))}}
        words = [(w, runs[max(NEAR, i), NEAR]) for i, w in enumerate(before, 1)] + [(w, runs[NEAR, max(NEAR, j)]) for j, w in enumerate(after, 1)]
        out += [(key, words) for key in (entity_key(text, span), group_key(text, span)) if key is not None]
    return out


def term_spans(text: str, spans: list[tuple[int, int, int]], terms: set[int]) -> list[tuple[int, int, int]]:
    if not terms:
        return []
    covered = Covered(spans)
    words = list(_WORD.finditer(text))
    hit = [m for m, h in zip(words, term_hashes([m[0] for m in words]).tolist(), strict=True) if h in terms]
    return [(5, *m.span()) for m in hit if not covered.meets(*m.span())]


def term_filter(terms: DataFrame) -> np.ndarray:
    """Flags of a fixed number of slots (2**24 at most): whether any term falls there, by its low bits."""
    bits = filter_bits(terms.count())
    at = F.pmod("term", F.lit(bits))
    rows = terms.groupBy((at / 32).cast("bigint").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 32).cast("int"))).alias("bits"))
    rows, table = rows.toArrow(), np.zeros((bits // 32, 32), bool)  # bits / 32 rows of two numbers at most
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()[:, None] >> np.arange(32) & 1
    return table.ravel()


def disclosing(docs: DataFrame, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, ratio) of terms that disclose an entity, and (doc, entity) of the texts, by hash, that hold entities."""
    spark = docs.sparkSession
    texts = docs.select("text", F.xxhash64("text").alias("doc")).filter("text is not null")

    def near(batches):
        for b in batches:
            rows, words, of = set(), [], []
            for text, doc in zip(b.column("text").to_pylist(), b.column("doc").to_pylist(), strict=True):
                spans = entities(text)
                if spans:
                    for e, terms in neighbours(text, spans):
                        rows.add((e, None, doc, None))
                        words += [w for w, _ in terms]
                        of += [(e, doc, c) for _, c in terms]
            rows.update((e, h, doc, c) for (e, doc, c), h in zip(of, term_hashes(words).tolist(), strict=True))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["entity", "term", "doc", "context"])

    seen = settled(texts.mapInArrow(near, "entity bigint, term bigint, doc bigint, context bigint").distinct())
    together = seen.groupBy("entity", "term").agg(F.countDistinct("doc").alias("n"), F.countDistinct("context").alias("contexts"))
    of_entity = together.filter("term is null").select("entity", F.col("n").alias("n_entity")).filter(F.col("n_entity") >= SUPPORT)
    total = texts.select("doc").distinct().count()
    # a term is in at least the documents where it stands near any entity; beyond ``most`` the ratio is too low
    near_any = seen.filter("term is not null").groupBy("term").agg(F.countDistinct("doc").alias("n_near"))
    most = F.col("n") * F.pow(F.lit(float(total)) / F.col("n_entity"), F.lit(1.0 - disclosure)) * 1.000001
    both = together.filter(F.col("term").isNotNull() & (F.col("n") >= SUPPORT) & (F.col("contexts") >= SUPPORT)).join(of_entity, "entity")
    both = settled(both.join(near_any, "term").filter(F.col("n_near") <= most).select("entity", "term", "n", "n_entity"))
    wanted = settled(both.select("term").distinct())
    shared = spark.sparkContext.broadcast(term_filter(wanted))

    def count(batches):
        sep, value = K.byte_table(letters_only=True)
        for b in batches:
            ids = b.column("doc").to_numpy()
            data, offs = K.text_bytes(pc.utf8_lower(b.column("text")))
            for lo, hi in K.slices(offs):
                part, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                starts, ends, bounds = K.word_bounds(part, o, sep)
                words = K.word_hashes(part, starts, ends, value)
                hit = np.flatnonzero(shared.value[(words & K.U(len(shared.value) - 1)).astype(np.int64)])
                doc = ids[lo + np.searchsorted(bounds, hit, "right") - 1]
                found = np.unique(np.stack([words[hit].view(np.int64), doc], 1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["term", "doc"])

    n_term = texts.mapInArrow(count, "term bigint, doc bigint").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    pmi = F.log(F.col("n") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    held = F.log(F.lit(float(total)) / F.col("n_entity"))
    rated = both.join(n_term, "term").withColumn("ratio", F.when(held > 0, pmi / held).otherwise(0.0))
    return settled(rated.filter(F.col("ratio") >= disclosure).select("entity", "term", "ratio")), seen.filter("term is null").select("doc", "entity")


def with_terms(docs: DataFrame, disclosure: float) -> DataFrame:
    """docs + _terms array<bigint>: the disclosing terms of the entities in each text.  Only texts with some are dealt."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    found, held = disclosing(docs, disclosure)
    terms = settled(held.join(found, "entity").groupBy(F.col("doc").alias("_key")).agg(F.collect_set("term").alias("_terms")))
    table = membership(terms, "_key", terms.count())
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    some = maybe_in(keyed, F.col("_key"), table).join(terms, "_key", "left").select(*names, "_terms")
    return some.union(maybe_in(keyed, F.col("_key"), table, negate=True).select(*names, F.lit(None).cast("array<bigint>").alias("_terms")))


def find(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, counts of the base kinds, base_sha256, spans, n_secret, n_term."""
    marked = with_terms(docs := only(docs, "doc_id", "text"), disclosure)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        name = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        for b in batches:
            counts, shas, all_spans = [], [], []
            for text, terms in zip(b.column("text").to_pylist(), b.column("_terms").to_pylist(), strict=True):
                spans = entities(text or "")
                spans = sorted(spans + term_spans(text or "", spans, set(terms or ())))
                counts.append(np.bincount([k for k, _, _ in spans], minlength=len(KINDS)))
                shas.append(hashlib.sha256(name([x for x in spans if x[0] < BASE_KINDS]).encode()).hexdigest())
                all_spans.append(name(spans))
            counts = np.array(counts, np.int64).reshape(-1, len(KINDS))
            c = [pa.array(counts[:, k].copy()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *c[:4], pa.array(shas, pa.string()), pa.array(all_spans, pa.string()), *c[4:]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_term"])

    return marked.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_secret bigint, n_term bigint")


def sanitised(text: str, terms: set[int]) -> str:
    """The text with every span generalised to its kind; where spans overlap, the first and longest covers the rest."""
    spans = entities(text)
    spans += term_spans(text, spans, terms)
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{KINDS[kind].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:] if spans else text


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """The documents with spans generalised in ``text``; the other columns stay (n_chars follows the text if it is there)."""
    names, docs = docs.columns, aside(docs, "doc_id", "text", "n_chars")
    marked = with_terms(docs, disclosure)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [t if t is None else sanitised(t, set(terms or ())) for t, terms in zip(b.column(at).to_pylist(), b.column("_terms").to_pylist(), strict=True)]
            columns = [pa.array(texts, b.schema.field(at).type) if i == at else c for i, c in enumerate(b.columns)]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([c for c, n in zip(columns, names, strict=True) if n != "_terms"], [n for n in names if n != "_terms"])

    clean = marked.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.toDF(*names)


def base_sql(table: str = "documents") -> str:
    """Counts of the base spans for DuckDB."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
ip AS (SELECT rid, count(*) AS n FROM (SELECT rid, m, bool_and(CASE WHEN length(ltrim(p, '0')) <= 3 THEN coalesce(nullif(ltrim(p, '0'), ''), '0')::integer <= 255 ELSE false END) AS fits
  FROM (SELECT rid, k, m, unnest(string_split(m, '.')) AS p FROM (SELECT rid, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (SELECT rid, regexp_extract_all(t, '[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)') AS ms FROM d))) GROUP BY rid, k, m) WHERE fits GROUP BY rid),
numbers AS (SELECT rid, k, digits FROM (SELECT rid, generate_subscripts(ms, 1) AS k, regexp_replace(unnest(ms), '[^0-9]', '', 'g') AS digits FROM (SELECT rid, regexp_extract_all(t, '[0-9](?:[\\x20-]?[0-9])+') AS ms FROM d)) WHERE length(digits) BETWEEN 16 AND 19),
card AS (SELECT rid, count(*) AS n FROM (SELECT rid, k, sum(CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END) % 10 AS rest
  FROM (SELECT rid, k, i, substr(reverse(digits), i::integer, 1)::integer AS x FROM numbers, range(1, 20) r(i) WHERE i <= length(digits)) GROUP BY rid, k) WHERE rest = 0 GROUP BY rid),
phone AS (SELECT rid, count(*) AS n FROM (SELECT rid, regexp_replace(unnest(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]')), '[^0-9]', '', 'g') AS digits FROM d) WHERE length(digits) BETWEEN 8 AND 15 GROUP BY rid)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))::bigint AS n_email, coalesce(ip.n, 0)::bigint AS n_ip, coalesce(card.n, 0)::bigint AS n_card, coalesce(phone.n, 0)::bigint AS n_phone
FROM d LEFT JOIN ip USING (rid) LEFT JOIN card USING (rid) LEFT JOIN phone USING (rid)"""
