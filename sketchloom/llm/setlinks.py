"""Sets of word shingles: links between those alike enough, confirmed on full sets from candidate links.

Candidates come from elsewhere (signatures, fingerprints). Their components bound where links can be, so each set travels to
its component once instead of once per candidate pair. There it is first compared with the set that names the component:
most families are settled by that. Only sets not linked by it are compared with the whole component, in blocks of
bounded weight, by an inverted index of shingles; each block emits a spanning forest of the links it finds, never all
pairs. No component, however large, is in one task, and nothing is capped.

Sets hold 64-bit hashes of shingles and are named by a 64-bit hash of all of them. Within two compared sets a clash has
a probability of about 2^-50; among 10^9 different sets two share a name with one of 3 %.

Defined cases: a text of fewer words than a shingle is one shingle, its whole sequence; a text without words has the
empty set, named 0, which is linked with nothing. A text of any length is one set; its words are hashed in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.blocks import blocked, met_in_groups
from sketchloom.functions.storage import join_checked, materialise
from sketchloom.functions.workers import frugal
from sketchloom.llm.runs import RADIX, mix
from sketchloom.operators.components import star_components, union_find_components

#: Nodes of a bucket from which it is cut into blocks.
BUCKET = 1024
#: Shingles that one group of compared sets holds, about.
WEIGHT = 1 << 18


def bucket_links(keyed: DataFrame, payload: DataFrame, link, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) from the Arrow function ``link`` over lists ``members`` of nodes that share a key, whatever ``bucket`` is.

    ``keyed`` (k, v, node): the keys of each node, k naming their kind; ``payload``: node and what ``link`` compares.
    """
    busy = materialise(keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("k", "v"), "busy-keys")
    rows = materialise(join_checked(keyed, busy, ["k", "v"], "left_semi"), "busy-rows")
    groups = met_in_groups(blocked(rows, ["k", "v"], F.xxhash64("node", "k"), bucket)).join(payload, "node")
    lists = groups.groupBy("k", "v", "_i", "_j").agg(F.collect_list(F.struct(*payload.columns)).alias("members"))
    return materialise(lists.select("members").mapInArrow(frugal(link), "src long, dst long").distinct(), "candidate-links")


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``size`` words; A-Z are lower-cased first."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    flat = mix(np.fromiter((xxhash.xxh3_64_intdigest(w) for own in words for w in own), np.uint64, sum(map(len, words))))
    radix, out, at = np.uint64(RADIX), [], 0
    chained = flat
    for j in range(1, size):
        chained = mix(chained[:-1] * radix + flat[j:]) if len(chained) else chained
    for own in words:
        n = len(own)
        if n >= size:
            out.append(np.unique(chained[at : at + n - size + 1]))
        elif n:
            short = flat[at : at + 1]
            for j in range(1, n):
                short = mix(short * radix + flat[at + j : at + j + 1])
            out.append(mix(short ^ np.uint64(n)))
        else:
            out.append(flat[:0])
        at += n
    return out


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit name of each set, 0 for the empty one only."""
    names = np.array([int(mix(s ^ np.uint64(RADIX)).sum(dtype=np.uint64)) + len(s) & (1 << 64) - 1 for s in sets], np.uint64)
    names = mix(names) | np.uint64(1)
    names[[len(s) == 0 for s in sets]] = 0
    return names.view(np.int64)


def linked(common: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


def _with_lead(size: int, percent: int):
    """Whether each set is linked with the set that names its component."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_set = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets, labels, out = shingle_sets(batch.column("_t").to_pylist(), size), batch.column("label").to_pylist(), []
                leads = batch.column("_lead")
                for k, (own, label) in enumerate(zip(sets, labels)):
                    if label != lead or lead_set is None:
                        lead, lead_set = label, shingle_sets([leads[k].as_py()], size)[0]
                    common = len(np.intersect1d(own, lead_set, assume_unique=True))
                    out.append(bool(linked(common, len(own), len(lead_set), percent)))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.bool_())], names=["node", "linked"])

    return check


def forest_of_sets(open_sets: list[np.ndarray], sets: list[np.ndarray], known: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) of open sets i with ``sets`` j that join different groups; ``known``: groups of ``sets`` so far, ``own[i]``: i's place among them or -1."""
    sizes = np.array([len(s) for s in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    group, links = known.copy(), []
    mine = np.full(len(open_sets), -1)
    fresh = (int(group.max()) if len(group) else 0) + 1
    for i, probe in enumerate(open_sets):
        low, high = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
        spans = high - low
        hits = owners[np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())]
        common = np.bincount(hits, minlength=len(sets))
        near = linked(common, len(probe), sizes, percent)
        if own[i] >= 0:
            near[own[i]] = False
            mine[i] = group[own[i]]
        else:
            mine[i], fresh = fresh, fresh + 1
        met, first = np.unique(group[near], return_index=True)
        at = np.flatnonzero(near)[first]
        for g, j in zip(met, at):
            if g != mine[i]:
                links.append((i, int(j)))
                group[group == g] = mine[i]
                mine[mine == g] = mine[i]
    return links


def _forest(size: int, percent: int):
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                rows = members.values
                node, role, settled = rows.field("node").to_numpy(), rows.field("role").to_numpy(), rows.field("settled").to_numpy(zero_copy_only=False)
                texts = rows.field("_t").to_pylist()
                everyone, probes = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
                if not len(everyone) or not len(probes):
                    continue  # hashing may leave a block empty
                sets = shingle_sets([texts[k] for k in everyone], size)
                place = {int(node[k]): n for n, k in enumerate(everyone)}
                known = np.where(settled[everyone], 0, 1 + np.arange(len(everyone)))  # what the component's name has linked is one group
                own = np.array([place.get(int(node[k]), -1) for k in probes])
                open_sets = [sets[p] if p >= 0 else shingle_sets([texts[k]], size)[0] for p, k in zip(own, probes)]
                found = forest_of_sets(open_sets, sets, known, own, percent)
                src = pa.array([int(node[probes[i]]) for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([src, pa.array([int(node[everyone[j]]) for _, j in found], pa.int64())], names=["src", "dst"])

    return forest


def confirmed(families: DataFrame, size: int, percent: int, weight: int = WEIGHT) -> DataFrame:
    """(src, dst): links whose components are those of all links with 100 * common >= ``percent`` * union.

    ``families`` (label, node, n, _t), written: the members of each candidate component, labelled by one of them; n: set size.
    """
    leads = families.filter("node = label").select("label", F.col("_t").alias("_lead"), F.col("n").alias("_ln"))
    apart = families.filter("node <> label").join(leads, "label")
    sized = 100 * F.least("n", "_ln") >= percent * F.greatest("n", "_ln")  # else they can't be linked
    looked = apart.filter(sized).select("label", "node", "_t", "_lead").mapInArrow(frugal(_with_lead(size, percent)), "node long, linked boolean")
    settled = materialise(looked.filter("linked").select("node"), "settled-sets")
    stars = join_checked(families.select("label", "node"), settled, ["node"], "left_semi").select(F.col("node").alias("src"), F.col("label").alias("dst"))
    others = join_checked(families.select("label", "node", "n").filter("node <> label"), settled, ["node"], "left_anti")
    others = materialise(others, "open-sets")
    if others.isEmpty():
        return stars
    # Open sets against their whole component; its blocks and theirs are cut by the shingles they hold.
    labels = materialise(others.select("label").distinct(), "open-components")
    marks = join_checked(families, labels, ["label"], "left_semi").join(settled.withColumn("settled", F.lit(True)), "node", "left")
    everyone = materialise(marks.withColumn("settled", F.coalesce("settled", F.col("node") == F.col("label"))), "open-members")
    spread = F.xxhash64("node")
    right = blocked(everyone, ["label"], spread, weight, F.col("n")).withColumnRenamed("_block", "_j").withColumnRenamed("_blocks", "_rights")
    left = blocked(everyone.filter("not settled"), ["label"], spread, weight, F.col("n")).withColumnRenamed("_block", "_i").withColumnRenamed("_blocks", "_lefts")
    count = lambda df, n: materialise(df.groupBy("label").agg(F.max(n).alias(n)), "block-counts")
    left, right = join_checked(left, count(right, "_rights"), ["label"]), join_checked(right, count(left, "_lefts"), ["label"])
    columns = ["label", "_i", "_j", "node", "role", "settled", "_t"]
    left = left.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_rights") - 1))).withColumn("role", F.lit(0)).select(columns)
    right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_lefts") - 1))).withColumn("role", F.lit(1)).select(columns)
    groups = left.unionByName(right).groupBy("label", "_i", "_j").agg(F.collect_list(F.struct("node", "role", "settled", "_t")).alias("members"))
    rest = materialise(groups.select("members").mapInArrow(frugal(_forest(size, percent)), "src long, dst long"), "open-links")
    return stars.unionByName(rest)


def families_of(candidates: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(label, node, n, _t) of the components of ``candidates`` (src, dst).

    ``sets`` (node, n, x, x_len): each set and a text that has it; ``texts`` (x, x_len, _t): all texts, repeats allowed.
    """
    parts = materialise(union_find_components(candidates), "candidate-components")
    members = materialise(sets.join(parts, "node").select("label", "node", "n", "x", "x_len"), "members")
    held = join_checked(texts, members.select("x", "x_len"), ["x", "x_len"], "left_semi").groupBy("x", "x_len").agg(F.first("_t").alias("_t"))
    return materialise(members.join(held, ["x", "x_len"]).select("label", "node", "n", "_t"), "families")


def components_of(candidates: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label): components of the confirmed links among candidate components; unlinked sets are missing."""
    links = confirmed(families_of(candidates, sets, texts), size, percent)
    return star_components(materialise(links, "confirmed-links"))
