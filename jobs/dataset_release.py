"""Dataset release: labelled documents, split per source, with everything that was left out and why.

    python -m jobs.dataset_release --documents PATH --labels PATH --output PATH [--config jobs/dataset_release.json]

Reads ``documents`` (doc_id, text, lang, source) and ``labels`` (doc_id and the label column), both Parquet. Below the output path it writes
one release, ``release=<name>``:

* ``samples``, partitioned by split and class_id: each labelled document with its class (``lang|label``; class ids are dense in the order of the
  names), its place in the seeded order of its source, and train, val or test by shares of the source;
* ``pool``: documents without a label, the ones to choose from for labelling;
* ``rejected``: labels and documents that cannot be used, each with the problem: a label that is empty, not numeric, not whole or negative, labels that
  contradict each other, labels without a document, documents without an id, with a repeated id or without a word;
* ``manifest``: per source, how many documents there are and how many went where; ``classes``: names and sizes.

Picks depend on seed and id alone, every table is replaced as a whole, and nothing is read that the job wrote: a rerun, after a failure or on
purpose, leaves the same release; other releases are not touched.

Scale: labels meet documents by id, on ids alone; a source's order is taken over range partitions (``split.spread_ranks``), so one source may hold any
share of the rows; texts move once to their sample's row and once more to be written in large files per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from jobs.common import log
from prismflow.operators import labels, split

#: Defaults; see dataset_release.json.
CONFIG = {"release": "current", "label": "quality", "seed": 42, "train": 0.8, "val": 0.1}
HAS_WORD = r"[^\x20\x09-\x0D]"
TABLES = ("samples", "pool", "rejected", "manifest", "classes")
#: Partitioned tables without rows have no file to read a schema from.
SCHEMAS = {
    "samples": "doc_id long, text string, lang string, source string, class string, rank long, split string, class_id long",
    "pool": "doc_id long, source string, lang string",
    "rejected": "table string, doc_id long, problem string",
}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def _bad(rows: DataFrame, table: str, problem: str | Column) -> DataFrame:
    return rows.select(F.lit(table).alias("table"), "doc_id", (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))


def usable_labels(raw: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, label), rejected): one whole label per id; ids whose labels differ are rejected, equal ones count once."""
    checked = labels.validated(raw.select("doc_id", F.col(label).cast("string").alias("raw")), "raw")
    problem = F.when(F.col("doc_id").isNull(), "no id").otherwise(F.col("problem"))
    fine = checked.where("doc_id is not null and problem is null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    odd = _bad(checked.where("doc_id is null or problem is not null"), "labels", problem)
    return fine.where("label = _other").select("doc_id", "label"), odd.unionByName(_bad(fine.where("label <> _other"), "labels", "labels differ"))


def usable_documents(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, lang), rejected), without the texts."""
    slim = raw.select("doc_id", "source", "lang", F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False)).alias("worded"))
    each = slim.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("source", "lang", "worded")))
    odd = _bad(slim.where("doc_id is null"), "documents", "no id").unionByName(_bad(each.where("n > 1"), "documents", "repeated id")).unionByName(_bad(each.where("n = 1 and not worded"), "documents", "no word"))
    return each.where("n = 1 and worded").select("doc_id", "source", "lang"), odd


def run(spark: SparkSession, documents: str, label_table: str, output: str, config: dict) -> dict[str, int]:
    """Write the release; returns the rows of each table."""
    texts, raw = spark.read.parquet(documents), spark.read.parquet(label_table)
    log.info("reading documents from %s and labels from %s", documents, label_table)
    at = {name: f"{output.rstrip('/')}/release={config['release']}/{name}" for name in TABLES}
    good, odd_labels = usable_labels(raw, config["label"])
    docs, odd_docs = usable_documents(texts)
    known = labels.joined(docs, good, "doc_id").withColumn("class", F.concat_ws("|", F.coalesce("lang", F.lit("")), "label"))
    known = known.select("doc_id", "source", "class")
    order = split.spread_ranks(known, "source", split.ticket(config["seed"], "doc_id"), "doc_id")
    classes = labels.dense_ids(order, "class").select("class", F.col("position").alias("class_id"))
    # As many rows as classes, languages times labels.
    common.write(classes.join(order.groupBy("class").agg(F.count("*").alias("n")), "class").coalesce(1), at["classes"])
    classes = spark.read.parquet(at["classes"]).select("class", "class_id")
    placed = order.join(classes, "class").withColumn("split", split.share_name(F.col("rank"), F.col("size"), config["train"], config["val"]))
    samples = texts.select("doc_id", "text", "lang").join(placed.select("doc_id", "source", "class", "class_id", "split", "rank"), "doc_id")
    done = {"samples": common.write(samples.hint("rebalance", "split", "class_id"), at["samples"], "split", "class_id")}
    chosen = _table(spark, at["samples"], "samples")
    done["pool"] = common.write(labels.unlabelled(docs, chosen.select("doc_id"), "doc_id"), at["pool"])
    unused = _bad(labels.unused(docs.select("doc_id"), good, "doc_id"), "labels", "no document")
    done["rejected"] = common.write(odd_labels.unionByName(odd_docs).unionByName(unused), at["rejected"])
    done["manifest"] = common.write(split.manifest(docs, "source", chosen.select("source", "split")), at["manifest"])
    done["classes"] = spark.read.parquet(at["classes"]).count()
    return done


def released(spark: SparkSession, output: str, config: dict) -> DataFrame:
    """All documents and labels of a release, one row each, by the table they went to."""
    at = f"{output.rstrip('/')}/release={config['release']}"
    names = ["doc_id", "source", "lang", "class", "class_id", "split", "rank", "problem"]
    out = None
    for name in ("samples", "pool", "rejected"):
        rows = _table(spark, f"{at}/{name}", name)
        kind = F.concat_ws(" ", F.lit(name), F.col("table")) if name == "rejected" else F.lit(name)
        kinds = {"doc_id": "long", "class_id": "long", "rank": "long"}
        text = F.sha2("text", 256) if name == "samples" else F.lit(None).cast("string")
        rows = rows.select(kind.alias("kind"), *((F.col(c) if c in rows.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in names), text.alias("text_sha256"))
        out = rows if out is None else out.unionByName(rows)
    return out


if __name__ == "__main__":
    common.main(run, "dataset release: labelled, split documents", ["documents", "labels"], CONFIG)
