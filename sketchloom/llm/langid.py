"""Language identification by Bayesian fusion of evidence.

log P(language | all) = prior of the host + likelihood of the text + likelihood of the declared language
+ likelihood of the address suffix, up to a constant.

* Text: a multinomial model over hashed byte 4-grams of the whole text, learnt from labelled rows. The
  log likelihood is divided by ``temper`` times the square root of its length beyond ``trusted`` grams, as
  neighbouring grams are not independent and a long text would drown all other evidence.
* Declared language and address suffix: P(value | language) from counts of what the text alone says,
  smoothed towards the value's overall share. The suffix counts here only, not in the prior as well.
* Host prior: counts of what the text alone says, per host, smoothed towards the registered domain's
  shares, those towards the corpus's.

A row is judged by the others: what its own text says is taken from every count before that is used for it.

All counts are grouped aggregates over all rows; hosts are joined, never gathered. The labelled sample
is unbounded: training counts are dense arrays of ``BUCKETS`` numbers per language and task, summed by
Spark. Only languages of at least ``MIN_SHARE`` of the labelled rows are learnt, so there are 500 of them at
most, whatever else a dirty column holds, and what reaches the driver doesn't grow.

Defined cases: a null or empty text says nothing, the other evidence decides; without any, the corpus's
shares do. Null hosts, suffixes and declarations are values of their own. Of equally likely languages the first
in alphabetical order is chosen. Repeated rows get equal results, and so do rows without an identifier. A text of
any length is scored as a whole, in batches of bounded bytes. Columns asked for with ``keep`` pass through;
``page_evidence`` and ``document_evidence`` replace columns named like the evidence that they make.
With no labelled row there is no language to choose and ``lang`` is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import materialise
from sketchloom.functions.workers import frugal
from sketchloom.llm.columns import held, released, schema_with

BUCKETS = 1 << 15
SMOOTH = 0.5
#: Share of the labelled rows from which on a language is learnt.
MIN_SHARE = 0.002
EVIDENCE = ["declared", "suffix", "domain", "host"]


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of each 4-gram that starts at each byte; grams may not cross a 0 byte."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    gram = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    found = ((gram * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)
    breaks = data == 0
    return np.where(breaks[:-3] | breaks[1:-2] | breaks[2:-1] | breaks[3:], -1, found)


def _join(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with a 0 byte behind each, and where each starts."""
    own = [(t or "").lower().encode("utf-8", "surrogatepass").replace(b"\0", b" ") for t in texts]
    starts = np.r_[0, np.cumsum([len(x) + 1 for x in own])]
    return np.frombuffer(b"\0".join(own) + b"\0", np.uint8), starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            langs = np.array(part.column("lang").to_pylist(), object)
            texts = part.column("_t").to_pylist()
            for lang in set(langs):
                data, _ = _join([texts[i] for i in np.flatnonzero(langs == lang)])
                found = gram_buckets(data)
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(found[found >= 0], minlength=BUCKETS)
    for lang, own in counts.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang] * BUCKETS, "bucket": np.arange(BUCKETS, dtype=np.int32), "n": own})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(bucket | language), from all rows whose language is known and not rare."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("_t"))
    per = materialise(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "langid-labels")
    total = per.agg(F.sum("rows")).first()[0] or 0
    learnt = [r["lang"] for r in per.filter(F.col("rows") >= MIN_SHARE * total).select("lang").collect()]  # 1 / MIN_SHARE at most
    rows = rows.filter(F.col("lang").isin(learnt))
    counted = rows.mapInArrow(frugal(_count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("c"))  # BUCKETS entries each
    found = {r["lang"]: np.array([x["n"] for x in r["c"]], np.float64) for r in packed.collect()}
    langs = sorted(found)
    table = np.array([found[x] for x in langs]).reshape(len(langs), BUCKETS) + SMOOTH
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _score(shared, trusted: float, temper: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                data, starts = _join(batch.column("_t").to_pylist())
                found = gram_buckets(data)
                known = found >= 0
                sums = np.zeros((batch.num_rows, len(table)))
                grams = np.zeros(batch.num_rows)
                if len(found):
                    edges = np.minimum(starts[:-1], len(found) - 1)
                    grams = np.add.reduceat(known, edges, dtype=np.float64)
                    grams[np.diff(starts) < 5] = 0
                    for k, own in enumerate(table):
                        sums[:, k] = np.add.reduceat(np.where(known, own[found], np.float32(0)), edges, dtype=np.float64)
                    sums[grams == 0] = 0
                scale = np.where(grams > trusted, temper * np.sqrt(np.maximum(grams, 1) / trusted), temper)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(table)), pa.array((sums / scale[:, None]).ravel()))
                kept = [c for c in batch.schema.names if c != "_t"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "loglik"])

    return score


def _sums(counts: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Per value of ``keys`` (renamed with _) an array ``name`` of what its rows' texts say, by language."""
    return counts.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.array(*(F.sum(f"n{k}") for k in range(n))).alias(name))


def _total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def identify(
    rows: DataFrame,
    model: tuple[list[str], np.ndarray],
    keep: list[str],
    trusted: float = 200.0,
    temper: float = 4.0,
    strength: float = 20.0,
) -> DataFrame:
    """(*keep, lang, probability, text_lang, host_prior) for ``rows`` (*keep, _t, declared, suffix, domain, host).

    ``strength``: how many rows of a level weigh as much as the level above it.
    """
    langs, table = model
    results = ["lang", "probability", "text_lang", "host_prior"]
    own = rows.select(held(keep), "_t", *EVIDENCE)
    if not langs:
        nothing = {"lang": "string", "probability": "double", "text_lang": "string", "host_prior": "double"}
        return own.select("_held", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())).select(*released(keep, results))
    shared = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    scored = own.mapInArrow(frugal(_score(shared, trusted, temper)), schema_with(own, ["_held", *EVIDENCE], "loglik array<double>"))
    scored = materialise(scored, "langid")
    n = len(langs)
    best = F.array_max("loglik")
    soft = F.transform("loglik", lambda x: F.exp(x - best))
    says = F.transform(soft, lambda x: x / _total(soft))
    counts = scored.select(*EVIDENCE, says.alias("s")).groupBy(*EVIDENCE).agg(*(F.sum(F.get("s", k)).alias(f"n{k}") for k in range(n)))
    counts = materialise(counts, "langid-counts")

    overall = [float(x or 0.0) for x in counts.agg(*(F.sum(f"n{k}") for k in range(n))).first()]
    everything = F.array(*(F.lit(x) for x in overall))
    hosts = _sums(counts, ["domain", "host"], n, "of_host")
    domains = _sums(counts, ["domain"], n, "of_domain").withColumnRenamed("_domain", "_d")
    hosts = materialise(hosts.join(domains, F.col("_domain").eqNullSafe(F.col("_d"))).drop("_d"), "langid-hosts")
    joined = scored.withColumn("s", says)
    for name in ("declared", "suffix"):
        values = materialise(_sums(counts, [name], n, f"of_{name}"), f"langid-{name}")
        joined = joined.join(values, F.col(name).eqNullSafe(F.col(f"_{name}")), "left").drop(f"_{name}")
    joined = joined.join(hosts, F.col("domain").eqNullSafe(F.col("_domain")) & F.col("host").eqNullSafe(F.col("_host")), "left")

    def others(name: str) -> Column:
        """Counts without what this row itself says."""
        return F.zip_with(name, "s", lambda a, x: F.greatest(a - x, F.lit(0.0)))

    def evidence(name: str) -> Column:
        """log P(value | language), smoothed by the value's share over all languages."""
        share = strength * _total(f"of_{name}") / max(sum(overall), 1e-9)
        return F.zip_with(others(f"of_{name}"), "rest", lambda a, all_: F.log((a + share) / (all_ + strength)))

    def smoothed(name: str, above: str) -> Column:
        return F.zip_with(others(name), above, lambda a, p: (a + strength * p) / (F.greatest(_total(name) - 1, F.lit(0.0)) + strength))

    joined = joined.withColumn("rest", F.zip_with(everything, "s", lambda a, x: F.greatest(a - x, F.lit(0.0))))
    joined = joined.withColumn("of_all", F.transform("rest", lambda a: (a + 1) / (_total("rest") + n)))
    joined = joined.withColumn("of_domain", smoothed("of_domain", "of_all"))
    joined = joined.withColumn("prior", F.transform(smoothed("of_host", "of_domain"), lambda p: F.log(p)))
    parts = joined.select("_held", "loglik", "prior", evidence("declared").alias("e1"), evidence("suffix").alias("e2"))
    fused = parts.withColumn("_s", F.transform("loglik", lambda x, k: x + F.get("prior", k) + F.get("e1", k) + F.get("e2", k)))

    def chosen(scores: str) -> Column:
        return F.get(F.array(*(F.lit(x) for x in langs)), (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))

    norm = _total(F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    picked = (F.array_position("_s", F.array_max("_s")) - 1).cast("int")
    found = fused.select("_held", chosen("_s").alias("lang"), (1.0 / norm).alias("probability"), chosen("loglik").alias("text_lang"), F.exp(F.get("prior", picked)).alias("host_prior"))
    return found.select(*released(keep, results))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with _t (markup removed), declared, suffix, domain and host."""
    known = F.coalesce(F.col(html), F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(known, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(known, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))
    labels = F.split("host", r"\.")
    return (
        pages.withColumn("host", F.when(host != "", host))
        .withColumn("suffix", F.when(F.col("host").isNotNull(), F.element_at(labels, -1)))
        .withColumn("domain", F.when(F.col("host").isNotNull(), F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2))))
        .withColumn("declared", F.when(declared != "", declared))
        .withColumn("_t", visible)
    )


def document_evidence(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with _t and their source as host; they declare no language and have no address."""
    none = F.lit(None).cast("string")
    return docs.withColumns({"_t": F.col(text), "declared": none, "suffix": none, "domain": none, "host": F.col(source)})
