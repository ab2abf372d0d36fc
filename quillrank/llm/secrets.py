"""Secret scans over a trigram inverted index, as native expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm._columns import packed, unpacked
from quillrank.llm._scratch import Scratch

#: Alternatives that a pattern's literal parts are spelled out to, at most; beyond, the part gives no trigrams.
MOST_SPELLED = 128


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern for leftmost matches without overlap, and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    fold: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.fold else "") + self.pattern


BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
]
#: Further kinds of well-known form.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_hook", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
]


def spelled(pattern: str) -> list[set[str]]:
    """Sets of lower-case strings, one of each of which every match must hold, from a pattern's literal parts."""
    runs: list[set[str]] = []

    def options(op: str, arg) -> set[str] | None:
        """All that a node matches, or None if that is too much."""
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN":
            out: set[str] = set()
            for o, a in arg:
                if str(o) == "LITERAL":
                    out.add(chr(a).lower())
                elif str(o) == "RANGE" and a[1] - a[0] < 16:
                    out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return out if len(out) <= 16 else None
        if op == "BRANCH":
            each = [whole(p) for p in arg[1]]
            return None if None in each else set().union(*each)
        if op == "SUBPATTERN":
            return whole(arg[-1])
        if op == "MAX_REPEAT" and arg[1] <= 4 and arg[1] != 0:
            once = whole(arg[2])
            if once is None:
                return None
            out = set()
            for n in range(arg[0], int(arg[1]) + 1):
                out |= {"".join(x) for x in product(once, repeat=n)}
            return out if len(out) <= MOST_SPELLED else None
        return None

    def whole(nodes) -> set[str] | None:
        now = {""}
        for op, arg in nodes:
            more = options(str(op), arg)
            if more is None or len(now) * len(more) > MOST_SPELLED:
                return None
            now = {a + b for a in now for b in more}
        return now

    def walk(nodes) -> None:
        now = {""}
        for op, arg in nodes:
            more = options(str(op), arg)
            if more is not None and len(now) * len(more) <= MOST_SPELLED:
                now = {a + b for a in now for b in more}
                continue
            runs.append(now)
            now = more or {""}
            if more is None and str(op) == "SUBPATTERN":
                walk(arg[-1])
        runs.append(now)

    import re._parser as parser  # the standard library's parser of patterns

    walk(parser.parse(pattern))
    return runs


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """A Boolean query in disjunctive form: a text can match only if it has all trigrams of one clause.

    Trigrams are of lower-cased text, so that the index serves patterns in either case. Of the parts that every match
    holds, the one with the longest shortest spelling is taken. An empty list: no trigram is mandatory, scan fully.
    """
    best = max(spelled(rule.pattern), key=lambda s: (min(map(len, s)), -len(s)))
    if min(map(len, best)) < 3:
        return []
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams over whole lower-cased texts; a null text has none.

    An index serves any rule whose query is within its trigrams. Rows of one doc_id share their postings.
    """
    has = F.transform(F.array(F.lower("text")), lambda t: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(t, g)))[0]
    return docs.select("doc_id", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """Documents that may hold each kind: postings of a clause's trigrams, intersected by counting. (doc_id, kinds)"""
    rows = [(r.kind, i, g, len(c)) for r in rules for i, c in enumerate(trigram_query(r)) for g in sorted(c)]
    clauses = index.sparkSession.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    # a row a trigram of the rules' clauses, at most MOST_SPELLED clauses a rule: their number doesn't follow the texts
    met = index.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "kind", "clause").agg(F.count_distinct("trigram").alias("n"), F.max("need").alias("need"))
    return met.where("n = need").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _long_enough(least: int):
    return lambda m: F.length(m) >= least


def _fold(rank: int, rule: Rule):
    """One step over the pieces between matches: the match after a piece becomes a span if its group is long enough."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["x"]["m"]
        new = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        kept = F.when(x["x"].isNotNull() & (x["x"]["g"] >= rule.least), F.concat(acc["out"], new)).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).alias("at"), kept.alias("out"))

    return step


def find_spans(rows: DataFrame, rules: list[Rule], may: dict[str, Column]) -> DataFrame:
    """(row, found) of rows with row and text. `found` is an array of (start, rank, end, kind) by start, then rank of the rule; code points, end exclusive.

    A rule's matches are its leftmost ones without overlap; one whose group is too short is dropped after it has
    taken its place. Offsets come from the lengths of the matches and of the pieces between them. `may` holds the
    condition under which a rule is tried on a row at all.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<string>")
    out = rows.withColumns({f"_m{i}": F.when(may[r.kind], F.regexp_extract_all(text, F.lit(r.java), F.lit(0))).otherwise(none) for i, r in enumerate(rules)})
    more = {}
    for i, r in enumerate(rules):
        some = F.size(f"_m{i}") > 0
        if r.least:
            # most texts have only short matches: these cost no more than their lengths
            some &= F.exists(f"_m{i}", _long_enough(r.least))
        more[f"_p{i}"] = F.when(some, F.split(text, F.lit(r.java), -1))
        more[f"_g{i}"] = F.when(some, F.col(f"_m{i}") if r.group == 0 else F.regexp_extract_all(text, F.lit(r.java), F.lit(r.group)))
    out = out.withColumns(more)
    each = []
    for i, r in enumerate(rules):
        pieces = F.zip_with(F.transform(F.col(f"_p{i}"), F.length), F.zip_with(F.col(f"_m{i}"), F.col(f"_g{i}"), lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), lambda p, x: F.struct(p.alias("p"), x.alias("x")))
        none_yet = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
        folded = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none_yet.alias("out")), _fold(i, r), lambda acc: acc["out"])
        each.append(F.coalesce(folded, none_yet))
    return out.select("row", F.array_sort(F.concat(*each)).alias("found"))


def scan(docs: DataFrame, rules: list[Rule] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Every row of `docs` with `found`, the spans of all secrets in its whole text.

    Rules with mandatory trigrams are verified only on the candidates that the index gives; the others scan every
    text. `index` is one that `build_index` made of these documents before, for at least the rules' trigrams. Postings
    meet the clauses where they are, and only matches are shuffled, by document. Candidates are written to shared
    storage: they are few, so that Spark joins them by their measured size (broadcast below its threshold, else a
    shuffle before which its run-time Bloom filter drops most texts on large inputs). A null or empty text has no
    spans. Repeated rows and rows that share a doc_id, null ones too, are each scanned on their own text. Other columns
    stay, whatever their names; one called `found` gives way. No rows give none.
    """
    rules = BASE + MORE if rules is None else rules
    indexed = [r for r in rules if trigram_query(r)]
    may = {r.kind: F.lit(True) for r in rules}
    rows = packed(docs, text=F.col("text"), **({"id": F.col("doc_id")} if indexed else {}))
    if indexed:
        trigrams = sorted({g for r in indexed for c in trigram_query(r) for g in c})
        index = build_index(docs, trigrams) if index is None else index
        found = Scratch(docs.sparkSession, "secrets").save(candidates(index, indexed), "candidates").withColumnRenamed("doc_id", "near_id")
        rows = rows.join(found, F.col("id").eqNullSafe(F.col("near_id")), "left").select("row", "text", "kinds")
        may |= {r.kind: F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind) for r in indexed}
    return unpacked(find_spans(rows, rules, may), docs.columns, found=F.col("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Replace every span (overlapping ones as one) by a mark, drop `found`, and count n_chars anew if it is there.

    Rows without spans keep their text, null ones too; other columns stay as they are.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    out = scanned.withColumn("text", F.when(F.size("found") > 0, clean).otherwise(F.col("text"))).drop("found")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out
