"""Operator 7: quality rules as weak supervision.

Each rule votes bad, good or abstains on figures of the whole text.  Rules that look at one fault from different sides
(FAULTS) depend on each other, so their agreement is no independent evidence about the document: it is evidence about
the fault.  Each fault is a hidden yes or no of its own.  Expectation-maximisation over the counts of the vote patterns
(at most 3 ** 10 rows, whatever the number of documents) estimates how common the fault is and, for each of its rules,
how often it votes bad with the fault and without it.  A document is good if it has no fault; the posterior probability
of that, the product over the faults, replaces all-must-pass rules.  A rule that votes bad alone while the others of its
fault deny it is outvoted where they would hardly have missed the fault, and stands where they abstain.

Priors are PRIOR_VOTES made-up votes for each rule, a constant, so the data decide; a fault of one rule alone could be
told from errors of the rule by nothing, so every fault has several.

The main path has DataFrame functions only; the driver sees the table of vote patterns and nothing else.

Defined cases: a null text has no words and fails the base rules; repeated rows count each and get equal verdicts; an
empty table gives an empty one (the model then keeps its priors); a null doc_id is carried along; columns that the
caller has under the names of figures are left alone, because figures live in one struct column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coomat.llm.tables import aside, maybe_in, membership, only, settled

#: Before any data a rule counts as PRIOR_VOTES votes on documents without its fault, of which it calls this share good, ...
RIGHT_ON_GOOD = 0.95
#: ... and as many on documents with it, of which it calls this share bad.
RIGHT_ON_FAULT = 0.9
PRIOR_VOTES = 10.0
#: And a fault as one document that has it among so many.
PRIOR_DOCUMENTS = 10.0

SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
#: Fixed patterns: symbols, capitals, ASCII punctuation.
SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-Z]"
PUNCTUATION = "[!-/:-@\\[-`{-~]"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIGURES = (*BASE, "n_lines", "n_upper", "n_bang", "n_stops", "n_chars", "longest_word", "n_punct", "n_distinct")
#: Rules in the order of their votes.
RULES = ("symbols", "punctuation", "repeats", "vocabulary", "dup_lines", "upper", "bangs", "word_length", "stops", "longest")
#: The rules that see each fault, by their places in RULES: noise (marks and capitals), repetition, no sentences.
FAULTS = ((0, 1, 5, 6), (2, 3, 4), (7, 8, 9))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def figures(docs: DataFrame, into: str = "_figures") -> DataFrame:
    """Adds a struct column of FIGURES, each a bigint; the text is read whole."""
    own = {x: f"{into}_{x}" for x in ("t", "w", "h", "l", "g", "s", "p")}
    t, w, h, lines, g, s, p = (F.col(f"`{own[x]}`") for x in own)
    nothing = F.array().cast("array<string>")
    bare = F.btrim(t, F.lit(SPACE))
    docs = docs.withColumn(own["t"], F.coalesce(F.col("text"), F.lit("")))

    def once(value: Column) -> Column:
        """An explode of one row: it keeps the optimiser from copying an expression into every later use of it."""
        return F.explode(F.array(value))

    docs = docs.withColumn(own["w"], once(F.when(bare == "", nothing).otherwise(F.split(bare, SPACES))))
    docs = docs.withColumn(own["l"], once(F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")))
    few = F.array().cast("array<bigint>")
    docs = docs.withColumn(own["h"], once(F.transform(w, lambda x: F.xxhash64(x))))
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    docs = docs.withColumn(own["g"], once(F.when(F.size(h) < WINDOW, few).otherwise(windows)))
    # Windows sorted by hash put equal ones side by side; only texts that repeat any window come to this.
    docs = docs.withColumn(own["s"], once(F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i")))))))
    twice = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
    docs = docs.withColumn(own["p"], once(F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))))
    gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    out = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(p.isNull(), F.lit(0)).otherwise(total),
        "n_lines": F.size(lines),
        "n_upper": F.regexp_count(t, F.lit(UPPER)),
        "n_bang": _count(t, "!"),
        "n_stops": _count(t, "."),
        "n_chars": F.length(t),
        "longest_word": F.coalesce(F.array_max(F.transform(w, lambda x: F.length(x))), F.lit(0)),
        "n_punct": F.regexp_count(t, F.lit(PUNCTUATION)),
        "n_distinct": F.size(F.array_distinct(h)),
    }
    return docs.withColumn(into, once(F.struct(*(v.cast("bigint").alias(k) for k, v in out.items())))).drop(*own.values())


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def votes(f: Column) -> dict[str, Column]:
    """-1 bad, 1 good, 0 abstains: by rule, in the order of RULES.  Between the two bounds of a rule it abstains."""

    def high(share: Column, bad: float, good: float, says: Column | None = None) -> Column:
        vote = F.when(share >= bad, -1).when(share <= good, 1).otherwise(0)
        return vote if says is None else F.when(says, vote).otherwise(0)

    words, chars, lines = (F.greatest(f[x], F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    length, some, many = f["word_chars"] / words, f["n_words"] >= 10, f["n_words"] >= 30
    out = {
        "symbols": high(f["n_symbols"] / words, 0.15, 0.02, some),
        "punctuation": high(f["n_punct"] / chars, 0.1, 0.05, some),
        "repeats": high(f["n_repeat_words"] / words, 0.2, 0.05, some),
        "vocabulary": -high(f["n_distinct"] / F.sqrt(words), 4.0, 2.5, many),
        "dup_lines": high(f["n_dup_lines"] / lines, 0.3, 0.1, f["n_lines"] >= 5),
        "upper": high(f["n_upper"] / chars, 0.4, 0.15, some),
        "bangs": high(f["n_bang"] / words, 0.2, 0.05, some),
        "word_length": F.when(~many, 0).when((length < 2) | (length > 14), -1).when((length > 3) & (length < 10), 1).otherwise(0),
        "stops": -high(f["n_stops"] / words, 0.03, 0.005, many),
        "longest": high(f["longest_word"], 200, 60, some),
    }
    return {r: out[r] for r in RULES}


#: For each fault its prior log odds, and for each of its rules what a bad and a good vote add to them.
Model = list[tuple[float, list[tuple[float, float]]]]


def start() -> Model:
    """Faults as common and rules as right as the priors say."""
    votes = math.log(RIGHT_ON_FAULT / (1 - RIGHT_ON_GOOD)), math.log((1 - RIGHT_ON_FAULT) / RIGHT_ON_GOOD)
    return [(math.log(1 / (PRIOR_DOCUMENTS - 1)), [votes] * len(rules)) for rules in FAULTS]


def _share(odds: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fault_odds(fault: tuple[float, list[tuple[float, float]]], votes: tuple[int, ...]) -> float:
    """Log odds that the fault is there, given the votes of its rules."""
    prior, ratios = fault
    return prior + sum(bad if x < 0 else good if x > 0 else 0.0 for x, (bad, good) in zip(votes, ratios, strict=True))


def quality(model: Model, pattern: tuple[int, ...]) -> float:
    """The probability that no fault is there, given all votes."""
    out = 1.0
    for fault, rules in zip(model, FAULTS, strict=True):
        out *= _share(-fault_odds(fault, tuple(pattern[j] for j in rules)))
    return out


def fit_fault(patterns: dict[tuple[int, ...], int], first: tuple[float, list[tuple[float, float]]], rounds: int) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes of the fault's rules, count).

    A rule that abstains says nothing.  A rule is no worse than chance: its bad vote never counts against the fault, nor
    its good vote for it; that and the priors tell the two classes apart.
    """
    fault, total, was = first, sum(patterns.values()), []
    for _ in range(rounds if total else 0):
        there = [_share(fault_odds(fault, v)) for v in patterns]
        if was and max(abs(a - b) for a, b in zip(was, there, strict=True)) < 1e-9:
            break
        was = there
        mass = sum(f * n for f, n in zip(there, patterns.values(), strict=True))
        ratios = []
        for j in range(len(first[1])):
            spoke, bad = [0.0, 0.0], [0.0, 0.0]  # without and with the fault
            for f, (v, n) in zip(there, patterns.items(), strict=True):
                if v[j]:
                    for k, share in ((0, 1 - f), (1, f)):
                        spoke[k] += share * n
                        bad[k] += share * n * (v[j] < 0)
            without = (bad[0] + (1 - RIGHT_ON_GOOD) * PRIOR_VOTES) / (spoke[0] + PRIOR_VOTES)
            along = (bad[1] + RIGHT_ON_FAULT * PRIOR_VOTES) / (spoke[1] + PRIOR_VOTES)
            ratios.append((max(0.0, math.log(along / without)), min(0.0, math.log((1 - along) / (1 - without)))))
        fault = math.log((mass + 1) / (total - mass + PRIOR_DOCUMENTS - 1)), ratios
    return fault


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> Model:
    """The model of (votes of all rules, count): each fault from the votes of its own rules."""
    out = []
    for first, rules in zip(start(), FAULTS, strict=True):
        own: dict[tuple[int, ...], int] = {}
        for v, n in patterns:
            key = tuple(v[j] for j in rules)
            own[key] = own.get(key, 0) + n
        out.append(fit_fault(dict(sorted(own.items())), first, rounds))
    return out


def learn(judged: DataFrame, into: str = "_figures") -> Model:
    """Counts the vote patterns of all rows (at most 3 ** len(RULES) groups) and fits the model."""
    named = votes(F.col(into))
    rows = judged.select(*(named[r].alias(r) for r in RULES)).groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit(sorted((tuple(r[x] for x in RULES), r["n"]) for r in rows))


def posterior(model: Model, f: Column) -> Column:
    """The probability of "good" given all votes: that of no fault."""
    cast, out = list(votes(f).values()), F.lit(1.0)
    for (prior, ratios), rules in zip(model, FAULTS, strict=True):
        total = F.lit(float(prior))
        for j, (bad, good) in zip(rules, ratios, strict=True):
            total = total + F.when(cast[j] == -1, bad).when(cast[j] == 1, good).otherwise(0.0)
        out = out / (1 + F.exp(total))
    return out


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, the base figures, base_failed, quality (the posterior), kept."""
    judged = settled(figures(only(docs, "doc_id", "text")).drop("text"))
    f, model = F.col("_figures"), learn(judged)
    good = posterior(model, f)
    return judged.select("doc_id", *(f[x].alias(x) for x in BASE), base_failed(f).alias("base_failed"), good.alias("quality"), (~base_failed(f) & (good >= threshold)).alias("kept"))


def good_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with their columns.

    A first pass keeps the figures of every text by its hash and fits the model.  A filter of fixed size over the hashes
    of rejected texts then parts the rows: what it lets go is good, and only the rest is figured and judged again, so
    texts are neither shuffled nor stored.  Where rejected texts outnumber the filter's bits, that rest is most rows.
    """
    names, docs, f = docs.columns, aside(docs, "doc_id", "text"), F.col("_figures")
    judged = settled(figures(docs.select("text")).select(F.xxhash64("text").alias("_key"), "_figures"))
    good = ~base_failed(f) & (posterior(learn(judged), f) >= threshold)
    bad = judged.filter(~good).select("_key").distinct()
    table, keyed = membership(bad, "_key", bad.count()), docs.withColumn("_key", F.xxhash64("text"))
    again = figures(maybe_in(keyed, F.col("_key"), table)).filter(good).drop("_figures", "_key")
    return maybe_in(keyed, F.col("_key"), table, negate=True).drop("_key").union(again).toDF(*names)


def base_sql(table: str = "documents") -> str:
    """The base figures and base_failed for DuckDB."""
    words = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, regexp_extract_all(t, '{words}+') AS ws FROM d),
f AS (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT rid, pos, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c, lead(a, 3) OVER p AS d, lead(a, 4) OVER p AS e FROM f WINDOW p AS (PARTITION BY rid ORDER BY pos)),
n AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, a, b, c, d, e) AS times FROM g WHERE e IS NOT NULL),
r AS (SELECT rid, count(DISTINCT pos + k) AS repeated FROM n, range({WINDOW}) x(k) WHERE times > 1 GROUP BY rid),
l AS (SELECT rid, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{words}') GROUP BY rid),
x AS (SELECT doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::bigint AS n_symbols, coalesce(dup, 0)::bigint AS n_dup_lines, coalesce(repeated, 0)::bigint AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x"""
