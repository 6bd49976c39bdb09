"""Line dedup with a log-template tree, in built-in functions only.

The tree has a fixed depth: the number of a line's tokens, then its leading tokens; a token with a digit
counts as the wildcard <*>. Lines that meet in a leaf vote, position by position, on the leaf's template:
a token that wins at least ``share`` of the votes stays, any other position becomes a wildcard. A line
belongs to the template if at least ``similar`` of its positions equal fixed tokens of it. Lines that don't
vote again among themselves, in finer groups where a vote places none, until no group has ``min_docs`` lines;
a line that is left is a template of its own, digits masked. A template that occurs in at least ``min_docs`` different
texts is recurring: its lines are dropped everywhere but in the text of the smallest identifier, so nothing
vanishes from the corpus altogether. Lines of other templates that are equal but for digits, with at least
``long`` tokens without one, recur from two different texts on. Texts are told apart by hash and
length, and copies of one text count once and get the same decisions.

Only leaves that occur in ``min_docs`` texts vote; the others cannot hold a recurring template, and of
their lines only the equal ones matter. Votes are cast by distinct lines, weighted, so a line that a third of all documents share is one
row by then.

Defined cases: a null text stays null and has no lines; blank lines are kept and never count. Repeated rows
get equal results. A template's ties are won by the greater token, and of texts of one identifier the one of the
smaller hash keeps a line. An empty table gives no rows. A text of any length is split in its own row, and
taken apart in one pass. Other columns pass through whatever their names are; only columns named n_lines and
n_dropped are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import join_checked, materialise

BLANKS = r"[\x20\x09-\x0D]+"
FILLED = r"[^\x20\x09-\x0D]"
WILD = "<*>"
#: A token with a digit; possessive, so that each token is read once.
DIGITS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
LEAF = ["n", "lead"]
#: A line that isn't in the text that keeps it.
OTHER = "x <> fx or x_len <> fl"


def line_tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANKS), "")


def masked_line(line: Column) -> Column:
    """``line`` with the wildcard for each token with a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, DIGITS, WILD)).otherwise(line)


def text_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("x"), F.length(text).alias("x_len")]


def lines(docs: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """(x, x_len, id, at, n, lead, tokens): the lines with a token, digits masked, at their places in the tree."""
    # Outer, and a filter on the line itself: others would be pushed down and repeat the work that made their columns.
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), *text_key(text), F.posexplode_outer(F.split(text, "\n")).alias("at", "line"))
    rows = rows.filter(F.col("line").rlike(FILLED)).select("x", "x_len", "id", "at", line_tokens(masked_line(F.col("line"))).alias("tokens"))
    return rows.select("x", "x_len", "id", "at", F.size("tokens").alias("n"), F.concat_ws(" ", F.slice("tokens", 1, depth)).alias("lead"), "tokens")


def smallest() -> Column:
    """What orders texts: the smallest identifier, null last."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("x").alias("x"), F.col("x_len").alias("x_len"))


def equal_lines(places: DataFrame, covered: DataFrame) -> DataFrame:
    """(x, x_len, at) of the long lines of ``places`` that other texts have too, but for the text of the smallest identifier.

    ``covered`` (n, lead, h): the lines that recurring templates decide on.
    """
    line = [*LEAF, "h"]
    kinds = places.filter("long").groupBy(*line).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "x_len")))
    again = kinds.filter("min_x <> max_x or min_x_len <> max_x_len").select(*line).join(covered, line, "left_anti")
    again = materialise(again, "equal-lines")
    found = materialise(join_checked(places.filter("long"), again, line).select("x", "x_len", "id", "at", *line), "equal-line-places")
    first = materialise(found.groupBy(*line).agg(F.min(smallest()).alias("first")).select(*line, F.col("first.x").alias("fx"), F.col("first.x_len").alias("fl")), "equal-line-firsts")
    return join_checked(found, first, line).filter(OTHER).select("x", "x_len", "at")


def placed_lines(distinct: DataFrame, min_docs: int, share: float, similar: float) -> DataFrame:
    """(n, lead, h, template_id): the template of each line of ``distinct`` (n, lead, h, line, weight).

    Each round takes one vote per group, a leaf at first. Lines that don't fit vote again among themselves; where
    none fitted, they part at the first token in which they differ. Groups of fewer than ``min_docs`` lines or of
    one kind are done: what is left of them are templates of their own.
    """
    group = [*LEAF, "g"]
    left, placed, level = distinct.withColumn("g", F.lit(0).cast("long")), None, 0
    while True:
        votes = left.select(*group, "weight", F.posexplode(F.split("line", " ")).alias("pos", "token")).groupBy(*group, "pos", "token").agg(F.sum("weight").alias("votes"))
        winners = votes.groupBy(*group, "pos").agg(F.max(F.struct("votes", "token")).alias("top"), F.sum("votes").alias("all"))
        winners = winners.withColumn("fixed", F.when(F.col("top.votes") >= share * F.col("all"), F.col("top.token")).otherwise(WILD))
        cut = F.min(F.when(F.col("top.votes") < F.col("all"), F.col("pos"))).alias("cut")
        templates = winners.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "fixed"))).alias("t"), cut)
        templates = materialise(templates.select(*group, F.transform("t", lambda p: p["fixed"]).alias("template"), "cut"), "leaf-templates")
        equal = F.size(F.filter(F.zip_with(F.split("line", " "), "template", lambda a, b: a == b), lambda same: same))
        voted = join_checked(left, templates, group).select(*group, "h", "line", "weight", "cut", (equal >= similar * F.col("n")).alias("fits"))
        voted = materialise(voted, "voted-lines")
        template_id = F.lit(0).cast("long") if level == 0 else F.xxhash64("g", F.lit(level))
        found = voted.filter("fits").select(*LEAF, "h", template_id.alias("template_id"))
        placed = found if placed is None else placed.unionByName(found)

        moved = materialise(voted.filter("fits").select(*group).distinct().withColumn("moved", F.lit(True)), "moved-groups")
        rest = join_checked(voted.filter("not fits"), moved, group, "left")
        parted = F.xxhash64("g", "cut", F.get(F.split("line", " "), F.col("cut")))
        rest = materialise(rest.select(*LEAF, F.when(F.col("moved"), F.col("g")).otherwise(parted).alias("g"), "h", "line", "weight"), "unplaced-lines")
        more = rest.groupBy(*group).agg(F.sum("weight").alias("lines"), F.count(F.lit(1)).alias("kinds")).filter((F.col("lines") >= min_docs) & (F.col("kinds") > 1))
        more = materialise(more.select(*group), "voting-groups")
        if more.isEmpty():
            break
        left, level = materialise(join_checked(rest, more, group, "left_semi"), "voting-lines"), level + 1
    placed = materialise(placed, "template-lines")
    own = F.coalesce("template_id", "h").alias("template_id")
    return materialise(distinct.select(*LEAF, "h").join(placed, [*LEAF, "h"], "left").select(*LEAF, "h", own), "placed-lines")


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 3, min_docs: int = 5, share: float = 0.5, similar: float = 0.7, long: int = 10) -> DataFrame:
    """(x, x_len, at): the lines to drop from each distinct text."""
    found = lines(docs, doc_id, text, depth)
    fixed = F.size(F.array_remove("tokens", WILD))
    # Texts are split into tokens once: the lines that leaves are made of are read back from here.
    places = found.select("x", "x_len", "id", "at", *LEAF, (fixed >= long).alias("long"), F.concat_ws(" ", "tokens").alias("line"))
    places = materialise(places.withColumn("h", F.xxhash64("line")), "line-places")
    busy = places.select("x", "x_len", *LEAF).distinct().groupBy(*LEAF).agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= min_docs)
    busy = materialise(busy.select(*LEAF), "busy-leaves")
    near = materialise(join_checked(places, busy, LEAF, "left_semi").select("x", "x_len", "id", "at", *LEAF, "h", "line"), "busy-lines")

    distinct = materialise(near.groupBy(*LEAF, "h").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("weight")), "distinct-lines")
    placed = placed_lines(distinct, min_docs, share, similar)
    of_line = materialise(join_checked(near, placed, [*LEAF, "h"]).select("x", "x_len", "id", "at", *LEAF, "template_id"), "line-templates")

    template = [*LEAF, "template_id"]
    per_text = of_line.groupBy(*template, "x", "x_len").agg(F.min(smallest()).alias("first"))
    recurring = per_text.groupBy(*template).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).filter(F.col("texts") >= min_docs)
    recurring = recurring.select(*template, F.col("first.x").alias("fx"), F.col("first.x_len").alias("fl"))
    recurring = materialise(recurring, "recurring-templates")
    dropped = join_checked(of_line, recurring, template).filter(OTHER)
    covered = materialise(join_checked(placed, recurring.select(*template), template, "left_semi").select(*LEAF, "h"), "covered-lines")
    return dropped.select("x", "x_len", "at").unionByName(equal_lines(places.drop("line"), covered)).distinct()


def drop_recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with ``text`` rid of recurring lines, plus n_lines and n_dropped."""
    gone = recurring_lines(docs, doc_id, text, **params).groupBy("x", "x_len").agg(F.array_sort(F.collect_list("at")).alias("gone"))
    gone = materialise(gone, "dropped-lines")
    others = [c for c in docs.columns if c != text]
    held = docs.select(F.col(text).alias("t"), (F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None)).alias("rest"), *text_key(text))
    # Texts move once whatever the number of dropped lines is, so cost grows with the corpus and not by jumps.
    joined = held.join(gone.hint("merge"), ["x", "x_len"], "left").withColumn("parts", F.split("t", "\n"))
    # What lies between one dropped line and the next one stays: one pass over the lines, however many go.
    none = F.array(F.lit(-1))
    pieces = F.zip_with(F.concat(none, "gone"), F.concat("gone", F.array(F.size("parts"))), lambda a, b: F.slice("parts", a + 2, b - a - 1))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    results = {
        "n_lines": F.coalesce(F.size(F.filter("parts", lambda line: line.rlike(FILLED))), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    passed = [(kept if c == text else F.col("rest").getField(c)).alias(c) for c in docs.columns if c.lower() not in results]
    return joined.select(*passed, *(value.alias(name) for name, value in results.items()))
