"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: a disjunction of conjunctions that every match must satisfy. The index holds, for each trigram that some query names, the postings of the texts containing it. Intersecting postings yields candidates (document, rule); only candidates are verified with the expression itself. A rule without mandatory trigrams (such as a bare run of hexadecimal digits) scans every text.

All steps are DataFrame functions. Trigrams are compared in lower case, so the index over-approximates rules that mind case and never misses; a rule's answer is always the expression's own.

Offsets are code points, end exclusive. A match's offset is the sum of the gaps (``split``) and matches before it; the sums are taken in blocks, so that a text with very many matches costs n^1.5 steps, not n^2.

Defined cases: a null text counts as empty and has no spans; null ids are scanned like others; rows that repeat an id are scanned each by its own text; an empty table gives an empty result; other columns are carried through unless named like a result column, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import documents, fresh


@dataclass(frozen=True)
class Rule:
    """``counted``: the group whose length must be ``least`` or more (0: the match). ``base``: one of the contract's kinds."""

    kind: str
    regex: str
    counted: int = 0
    least: int = 1
    base: bool = False


# The three base kinds as the contract states them, then well-known public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)

#: A set of strings larger than this is no longer followed; the query then asks for less.
MOST_STRINGS = 48


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """The disjunction of trigram sets of which each match contains one whole; None if a match need not contain any trigram."""
    anything = [frozenset()]

    def both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
        return least({x | y for x in a for y in b})

    def least(found: set[frozenset]) -> list[frozenset]:
        return sorted((x for x in found if not any(y < x for y in found)), key=sorted)

    def of(strings: set[str]) -> list[frozenset]:
        return least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})

    def exact(node) -> set[str] | None:
        """All strings of a node in lower case, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            chars = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is sre.SUBPATTERN:
            return exact_all(arg[3])
        if op is sre.BRANCH:
            parts = [exact_all(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = exact_all(inner) if high is not sre.MAXREPEAT and high <= 8 else None
            found = None if one is None else {"".join(p) for n in range(low, high + 1) for p in product(one, repeat=n)}
            return found if found is not None and len(found) <= MOST_STRINGS else None
        return None

    def exact_all(nodes) -> set[str] | None:
        found = {""}
        for node in nodes:
            more = exact(node)
            if more is None or len(found) * len(more) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in more}
        return found

    def query(nodes) -> list[frozenset]:
        asked, run = anything, {""}
        for node in nodes:
            more = exact(node)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            asked, run = both(asked, of(run)), {""}
            op, arg = node
            if more is not None:
                run = more
            elif op is sre.SUBPATTERN:
                asked = both(asked, query(arg[3]))
            elif op is sre.BRANCH:
                asked = both(asked, least({x for p in arg[1] for x in query(p)}))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                asked = both(asked, query(arg[2]))
        return both(asked, of(run))

    found = query(sre_parse.parse(regex))
    return None if frozenset() in found else found


def _index(docs: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key): which texts contain which of ``trigrams``. The text is folded once; a literal condition for each trigram would make a method too large to be compiled."""
    names = F.array(*[F.lit(t) for t in trigrams])
    present = F.transform(F.array(F.lower(F.col(text))), lambda folded: F.filter(names, lambda t: F.contains(folded, t)))
    return docs.select(F.col(key).alias("posted"), _mark(key, text).alias("mark"), F.explode(F.element_at(present, 1)).alias("trigram"))


def _mark(key: str, text: str) -> Column:
    """Of a document without an id, its text's hash: else all of them would meet under one key."""
    return F.when(F.col(key).isNull(), F.xxhash64(text))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """posted, mark, rules: the rules (by number) whose trigram query a document satisfies. Documents without any are absent."""
    spark = docs.sparkSession
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex)) is not None}
    trigrams = sorted({t for q in asked.values() for c in q for t in c})
    if not trigrams:
        return docs.select(F.col(key).alias("posted"), _mark(key, text).alias("mark"), F.array().cast("array<int>").alias("rules")).limit(0)
    # One row for each rule, conjunction and trigram: as many as the rules have, whatever the data
    terms = [(i, j, t, 1 << k, (1 << len(c)) - 1) for i, q in asked.items() for j, c in enumerate(q) for k, t in enumerate(sorted(c))]
    terms = spark.createDataFrame(terms, "rule int, conjunction int, term string, bit long, all long")
    return (
        _index(docs, key, text, trigrams)
        .join(F.broadcast(terms), F.col("trigram") == F.col("term"))
        .groupBy("posted", "mark", "rule", "conjunction")
        .agg(F.bit_or("bit").alias("met"), F.first("all").alias("all"))
        .filter("met = all")
        .groupBy("posted", "mark")
        .agg(F.collect_set("rule").alias("rules"))
    )


def necessary(rule: Rule) -> str | None:
    """What a text must contain for a rule that is one class of characters, repeated: a run of the least length."""
    parsed = list(sre_parse.parse(rule.regex))
    single = len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and parsed[0][1][:2] == (1, sre.MAXREPEAT) and [op for op, _ in parsed[0][1][2]] == [sre.IN]
    return f"{rule.regex[:-1]}{{{rule.least}}}" if single and rule.counted == 0 and rule.regex.endswith("]+") else None


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of the rule's matches in ``text``."""
    rx = F.lit(rule.regex)
    matches, counted = F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(rule.counted))

    def placed(found: Column) -> Column:
        gap = F.transform(F.split(text, rule.regex, -1), lambda g: F.length(g))
        size = F.transform(found, lambda m: F.length(m))
        both = F.zip_with(F.slice(gap, F.lit(1), F.size(found)), size, lambda g, m: g + m)

        def sums(step: Column) -> Column:
            block = F.ceil(F.sqrt(F.size(step))).cast("int")
            total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

            def inside(width: Column) -> Column:
                # the sum of each block, then of all blocks before it, then of the steps up to each match
                each = F.transform(F.sequence(F.lit(0), F.ceil(F.size(step) / width).cast("int") - 1), lambda b: total(F.slice(step, b * width + 1, width)))
                before = _let(each, lambda e: F.transform(e, lambda _, b: total(F.slice(e, F.lit(1), b))))
                return _let(before, lambda at: F.transform(step, lambda _, k: F.element_at(at, F.floor(k / width).cast("int") + 1) + total(F.slice(step, F.floor(k / width).cast("int") * width + 1, k % width + 1))))

            return _let(block, inside)

        ends = _let(both, sums)
        spans = _let(size, lambda s: F.transform(ends, lambda e, k: F.struct((e - F.element_at(s, k + 1)).alias("start"), F.lit(number).alias("rule"), e.alias("end"))))
        keep = F.transform(counted, lambda c: F.length(c) >= rule.least)
        return _let(keep, lambda ok: F.filter(spans, lambda _, k: F.element_at(ok, k + 1)))

    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    likely = F.exists(counted, lambda c: F.length(c) >= rule.least)
    return F.when(likely, placed(matches)).otherwise(none).cast("array<struct<start:int,rule:int,end:int>>")


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, rule, end) in order of start, then rule; rule is the number in ``rules``."""
    posted, mark, asked = fresh(docs, "posted"), fresh(docs, "mark"), fresh(docs, "rules")
    found = candidates(docs, rules, key, text).toDF(posted, mark, asked)
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    each = []
    for i, rule in enumerate(rules):
        spans = _spans(body, rule, i)
        if (run := necessary(rule)) is not None:
            spans = F.when(F.rlike(body, F.lit(run)), spans).otherwise(none)
        if trigram_query(rule.regex) is not None:
            spans = F.when(F.array_contains(F.coalesce(asked, F.array().cast("array<int>")), i), spans).otherwise(none)
        each.append(spans)
    same = F.col(key).eqNullSafe(F.col(posted)) & _mark(key, text).eqNullSafe(F.col(mark))
    return docs.join(found, same, "left").withColumn("secret_spans", F.array_sort(F.concat(*each))).drop(posted, mark, asked)


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of secrets (overlapping ones as one) in ``text`` replaced by ``mask``."""
    found = scanned(docs, rules, key, text)
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(done: Column, span: Column) -> Column:
        fresh = F.concat(done["parts"], F.array(F.substring(body, done["at"] + 1, span["start"] - done["at"]), F.lit(mask)))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.when(span["start"] >= done["at"], fresh).otherwise(done["parts"]).alias("parts"))

    end = lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(body, done["at"] + 1, F.length(body)))
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, F.aggregate("secret_spans", start, add, end)).otherwise(body)).drop("secret_spans")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base kinds and the index's further rules over all documents; see the module."""
    base = F.filter("secret_spans", lambda s: s["rule"].isin([i for i, r in enumerate(RULES) if r.base]))
    count = lambda i: F.size(F.filter("secret_spans", lambda s: s["rule"] == i)).cast("long")
    return scanned(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"),
    )
