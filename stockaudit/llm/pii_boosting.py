"""Personal data: base forms, and spans that boosted trees accept from high-recall generators.

Base forms are found by their patterns and kept if they are valid. Generators propose wider, overlapping
spans (spelled-out addresses, numbers in groups). Trees score a proposal by its format and the text before
it. They learn from valid base forms rewritten as a generator would meet them (signs spelled out, plus and
country code taken off, groups changed), each with the text before it, and from candidates that fail: wrong
check digits, numbers of parts or digits, dates, amounts, plain numbers. A threshold calibrated for each kind
on a part of these rows kept from training decides. Both see all rows, none a sample. Only DataFrame functions and Spark's own trees are used.

Java's matcher recurses over repeated groups, so long runs could exhaust its stack. Borders that would
need a group (a dot between labels, a separator between digits) are first replaced by one private
character of the same length; what is left to match are runs of one character class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stockaudit.llm import boosting, tables
from stockaudit.llm.tables import free_name, landed

KINDS = ("email", "ip", "card", "phone")
INNER, OTHER = "\ue001", "\ue002"  # stands for an inner dot or separator; stands for itself where a text has it
LOCAL = "A-Za-z0-9._%+" + INNER + "-"
TAIL = 24
PRECISION = 0.98
SCORE_CELLS = 1_000_000  # scores are told apart, and thresholds chosen, to this part of one

_MARKED_DOTS = ("(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", INNER)
_MARKED_GAPS = ("(?<=[0-9])[ -](?=[0-9])", INNER)
# Name: what must occur, border to mark, pattern. The email pattern may start where the last match ended, or
# where a run of its characters starts; anywhere else a longer match would have started before.
SEARCHES = {
    "email": ("@", _MARKED_DOTS, f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{INNER}[A-Za-z0-9{INNER}-]*+"),
    "ip": ("[0-9]\\.[0-9]", None, "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"),
    "card": ("[0-9][0-9 -]{14}", _MARKED_GAPS, f"[0-9][0-9{INNER}]{{15,}}+"),
    "phone": ("\\+[0-9]", None, "\\+[0-9][ ().0-9-]+[0-9]"),
    "spelled": (
        "(?i)[(\\[](?:at|dot)[)\\]]", None,
        "(?i)[A-Z0-9._%+-]{1,64}+ ?(?:@|[(\\[]at[)\\]]) ?[A-Z0-9-]{1,64}(?: ?(?:\\.|[(\\[]dot[)\\]]) ?[A-Z0-9-]{1,64}){1,6}",
    ),
    "numbers": ("[0-9][0-9 ().-]{5}", None, "(?<![0-9A-Za-z])[(]?[0-9][0-9 ().-]{5,26}[0-9](?![0-9A-Za-z])"),
}
GENERATORS = ("spelled", "numbers")
FEATURES = ("length", "digits", "groups", "longest_group", "dots", "spaces", "hyphens", "parentheses", "letters", "colon_before", "line_start", "word_before", "digit_before", "check_digit", "zero_first")


def _found(text: Column, name: str) -> Column:
    """Matches in order, each with the length and the end of the text since the last one; null if none can occur."""
    needed, marked, pattern = SEARCHES[name]
    held = text.contains(needed) if needed == "@" else text.rlike(needed)
    if marked:
        text = F.regexp_replace(F.translate(text, INNER, OTHER), F.lit(marked[0]), F.lit(marked[1]))
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(gaps, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.right(gap, F.lit(TAIL)).alias("tail"), match.alias("match")))
    return F.when(held, F.filter(rows, lambda row: row["match"].isNotNull()))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    parts = F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", parts)
        .when(kind == "card", F.when(n.between(16, 19), luhn(_digits(match))).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
    )


def _placed(searched: DataFrame) -> DataFrame:
    """A row a match: ``row, search, start, end, match, tail``; positions count code points from 0."""
    each = [
        searched.select("row", F.lit(name).alias("search"), F.posexplode(name).alias("at", "m")) for name in SEARCHES
    ]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionAll(more)
    before = Window.partitionBy("row", "search").orderBy("at")
    end = F.sum(F.col("m.gap") + F.length("m.match")).over(before)
    placed = rows.select("row", "search", "m.tail", F.col("m.match").alias("raw"), end.alias("end"))
    separator = F.when(F.col("search") == "email", ".").otherwise("-")
    return placed.select(
        "row", "search", "tail", (F.col("end") - F.length("raw")).alias("start"), "end", F.replace("raw", F.lit(INNER), separator).alias("match")
    )


def _described(proposals: DataFrame) -> DataFrame:
    """Format and context of proposals. An address sign and its spelling count alike, and a leading plus not at all."""
    m, tail = F.col("match"), F.col("tail")
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    count = lambda pattern: F.length(F.regexp_replace(m, pattern, "")).cast("double")
    return proposals.withColumns({
        "length": F.length(m).cast("double"),
        "digits": count("[^0-9]"),
        "groups": F.size(groups).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "dots": count("[^.]"),
        "spaces": count("[^ ]"),
        "hyphens": count("[^-]"),
        "parentheses": count("[^()]"),
        "letters": count("[^A-Za-z]"),
        "colon_before": tail.rlike("[:=]\\s*$").cast("double"),
        "line_start": ((tail == "") | tail.endswith("\n")).cast("double"),
        "word_before": tail.rlike("\\p{L}[ .,]*\\+?[0-9]{0,2} ?$").cast("double"),
        "digit_before": tail.rlike("[0-9] ?$").cast("double"),
        "check_digit": F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(False).cast("double"),
        "zero_first": m.rlike("^[(]?0").cast("double"),
    })


def _kind(match: Column) -> Column:
    """The kind a proposal would be."""
    return (
        F.when(match.rlike("(?i)@|[(\\[]at[)\\]]"), "email")
        .when(match.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"), "ip")
        .when(F.length(_digits(match)) >= 16, "card")
        .otherwise("phone")
    )


# Numbers that are something else: dates, amounts, spans of years, decimal numbers.
_OTHER_NUMBERS = (
    "^(?:[0-9]{1,4}[.-][0-9]{1,2}[.-][0-9]{1,4}|[1-9][0-9]{0,2}(?:[ .][0-9]{3})+|(?:1[0-9]|20)[0-9]{2} ?- ?(?:1[0-9]|20)[0-9]{2}|[0-9]+\\.[0-9]+)$"
)


def _fails(kind: Column, match: Column) -> Column:
    """Whether a proposal cannot be of its kind."""
    n = F.length(_digits(match))
    return (
        F.when(kind == "email", ~match.rlike("(?i)[A-Z]{2,}$"))
        .when(kind == "ip", ~_valid(F.lit("ip"), match))
        .when(kind == "card", ~F.coalesce(_valid(F.lit("card"), match), F.lit(False)))
        .otherwise(~n.between(7, 15) | ~match.rlike("[^0-9]") | match.rlike(_OTHER_NUMBERS))
    )


def _rewritten(kind: Column, match: Column) -> Column:
    """A base form as a generator would meet it where the base pattern does not; one of three ways, by its hash."""
    way = F.pmod(F.xxhash64(match), F.lit(3))
    pick = lambda *ways: F.when(way == 0, ways[0]).when(way == 1, ways[1]).otherwise(ways[2])

    def spelled(at: str, dot: str) -> Column:
        return F.regexp_replace(F.regexp_replace(match, "\\.(?=[^@]*$)", dot), "@", at)

    bare = F.regexp_replace(match, "^\\+[0-9]{1,3}[ .-]*", "")
    grouped = F.when(bare.rlike("[^0-9]"), bare).otherwise(F.regexp_replace(bare, "^([0-9]{2,3})(?=[0-9])", "$1 "))
    digits = _digits(match)
    fours = lambda sign: F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1" + sign)
    return (
        F.when(kind == "email", pick(spelled(" (at) ", " (dot) "), spelled("[at]", "[dot]"), spelled(" [at] ", ".")))
        .when(kind == "phone", pick(F.concat(F.when(grouped.rlike("^[0-9]"), "0").otherwise(""), grouped), grouped, F.concat(F.when(grouped.rlike("^[1-9]"), "0").otherwise(""), F.translate(grouped, " .", "--"))))
        .when(kind == "card", pick(fours("."), fours(" - "), fours(" . ")))
        .otherwise(match)
    )


def _evidence(placed: DataFrame, proposals: DataFrame) -> DataFrame:
    """``kind, match, tail, label``, each once: rewritten base forms, valid or not, and proposals that fail."""
    base = placed.where(F.col("search").isin(*KINDS)).select(
        F.col("search").alias("kind"), _rewritten(F.col("search"), F.col("match")).alias("match"), "tail", F.coalesce(_valid(F.col("search"), F.col("match")), F.lit(False)).cast("double").alias("label")
    )
    met = F.lit(False)
    for name in GENERATORS:
        met = met | F.col("match").rlike(f"^(?:{SEARCHES[name][2]})$")
    # A rewritten form that a proposal could not be teaches nothing; a valid base form may have become one that fails.
    base = base.where(met & (_kind(F.col("match")) == F.col("kind")) & ((F.col("label") == 0) | ~_fails(F.col("kind"), F.col("match"))))
    failing = proposals.where(_fails(F.col("kind"), F.col("match")) & ~F.col("overlaps")).select("kind", "match", "tail", F.lit(0.0).alias("label"))
    return base.unionAll(failing).groupBy("kind", "match", "tail").agg(F.max("label").alias("label"))


def _accepted(placed: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals outside base spans whose score reaches the threshold of their kind: ``row, kind, start, end, score``."""
    nothing = proposals.where(F.lit(False)).select("row", "kind", "start", "end", F.lit(0.0).alias("score"))
    # Every row counts: equal ones of a kind and label are one with their number, which is what trees and thresholds weigh.
    evidence = _described(_evidence(placed, proposals)).withColumn("kept_back", F.pmod(F.xxhash64("match", "tail"), F.lit(4)) == 0)
    evidence = landed(evidence.groupBy("kind", "label", "kept_back", *FEATURES).agg(F.count(F.lit(1)).alias("n")), "evidence")
    model = boosting.fit(evidence.where(~F.col("kept_back")), FEATURES, "label", "n")
    if model is None:
        return nothing
    # The lowest score down to which enough of the kept-back rows of a kind are right.
    cell = F.floor(F.col("score") * SCORE_CELLS)
    cells = boosting.scored(model, evidence.where("kept_back"), "score").groupBy("kind", cell.alias("cell")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")
    )
    down = Window.partitionBy("kind").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("precision", F.sum("right").over(down) / F.sum("n").over(down))
    bars = cells.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("cell").alias("bar")).collect()
    if not bars:
        return nothing
    bar = F.create_map(*[F.lit(x) for r in bars for x in (r.kind, r.bar)])  # at most one entry a kind
    open_ones = proposals.where(~F.col("overlaps") & ~_fails(F.col("kind"), F.col("match")))
    return boosting.scored(model, open_ones, "score").where(cell >= bar[F.col("kind")]).select("row", "kind", "start", "end", "score")


def spans(docs: DataFrame, *carried: str) -> DataFrame:
    """A row per row of ``docs``: ``carried`` columns, ``base`` and ``all_spans``, arrays of (order, kind, start, end).

    Null text is empty. Rows are told apart by a number of their own, so repeated or null ids do no harm.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    searched = landed(
        docs.select(
            F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(f"c_{c}") for c in carried], *[_found(text, name).alias(name) for name in SEARCHES]
        ),
        "searched",
    )
    placed = landed(_placed(searched), "placed")
    is_base = F.col("search").isin(*KINDS)
    base = placed.where(is_base & _valid(F.col("search"), F.col("match"))).select("row", F.col("search").alias("kind"), "start", "end")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    listed = lambda df, name: df.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "kind", "start", "end"))).alias(name))
    base = listed(base, "base")
    # What a proposal is compared with: the base spans of its own row.
    near = placed.where(~is_base).join(base, "row", "left")
    hit = lambda test: F.coalesce(F.exists("base", test), F.lit(False))
    overlap = hit(lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    proposals = near.withColumns({"kind": _kind(F.col("match")), "overlaps": overlap})
    proposals = landed(_described(proposals).select("row", "kind", "start", "end", "match", "tail", "overlaps", *FEATURES), "proposals")
    added = listed(_accepted(placed, proposals), "added")
    empty = F.array().cast("array<struct<order:int,kind:string,start:bigint,end:bigint>>")
    found = landed(base.join(added, "row", "full_outer"), "found")
    # Rows without a span, most of them, need no join.
    likely, sure = tables.split_by_membership(searched.select("row", *[f"c_{c}" for c in carried]), "row", found.select("row"), tables.LISTED_ROWS)
    joined = likely.join(F.broadcast(found) if sure is None else found, "row", "left")
    if sure is not None:
        joined = joined.unionByName(sure.withColumns({name: F.lit(None).cast(found.schema[name].dataType) for name in ("base", "added")}))
    joined = joined.withColumns({"base": F.coalesce("base", empty), "added": F.coalesce("added", empty)})
    # Of accepted proposals that overlap, the one that starts first stays, the longer of two.
    own = F.filter(
        "added",
        lambda a: ~F.exists("added", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"]) & (F.struct(b["start"], -b["end"], b["order"]) < F.struct(a["start"], -a["end"], a["order"]))),
    )
    return joined.select(*[F.col(f"c_{c}").alias(c) for c in carried], "base", F.array_sort(F.concat("base", own)).alias("all_spans"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each row; other columns are not carried."""
    found = spans(docs.select("doc_id", "text"), "doc_id")

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` renewed where there is one.

    Overlapping spans of different kinds are replaced together, by the kind that starts first. Null text stays null.
    Columns may have any names: they are carried by number.
    """
    own = {name: f"own_{number}" for number, name in enumerate(docs.columns)}
    found = spans(docs.select("text", *[F.col(name).alias(number) for name, number in own.items()]), *own.values())
    old = F.col(own["text"])
    ranges = F.array_sort(F.transform("all_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, s: Column) -> Column:
        before = F.substring(old, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        return F.when(s["start"] < done["at"], F.struct(done["out"].alias("out"), F.greatest(done["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(done["out"], before, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at"))
        )

    whole = F.aggregate(ranges, start, step, lambda done: F.concat(done["out"], F.substring(old, (done["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    text = F.when(old.isNull() | (F.size("all_spans") == 0), old).otherwise(whole)
    out = found.select(*[(text if name == "text" else F.col(number)).alias(name) for name, number in own.items()])
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
