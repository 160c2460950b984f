"""Token totals by source, language and tokenizer version, kept current by deltas.

Totals are sums, so a change needs no recount: an insert adds a document's counts, a delete
takes them off, and a revision does both. Changes come in batches, each with an id. A batch is
summed by key first (a hot source becomes one row a task before the shuffle) and committed as
one small table of signed rows; the totals are the sum of all committed batches, and the next
reader sees a batch wholly or not at all.

Commits are idempotent. A batch is written to a folder of its own and then renamed to
`batch=<id>`; the rename is the commit. A batch id that is there already is left as it is, so
a job may send a batch again after any failure. `compact` folds batches into one base row set
under the same rule. All file work goes through Spark's file systems, and the store must rename a
folder atomically, as HDFS and POSIX file systems do and object stores do not: there, keep the
folder on such a file system or behind a store layer that has the rename.

Tokenizer versions are names. Those of the query are two vocabulary files, run by their own
library, and the plain count of words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.packing import ordinary
from millwright.session import sliced, staged, table, work_folder

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens"]
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
BATCH = re.compile(r"[A-Za-z0-9_.-]+")


def word_count(text: str) -> int:
    """Runs of characters but space and \\t to \\r."""
    return len(text.encode("utf-8", "surrogatepass").split())


def token_count(vocabulary: str) -> Callable[[str], int]:
    """Ids of a text under a vocabulary file, special tokens' names being ordinary text."""
    return lambda text: len(ordinary(vocabulary).encode_ordinary(text))


#: Tokenizer versions by name: a count of a text's tokens. A new version is a new name.
TOKENIZERS: dict[str, Callable[[str], int]] = {"byte_bpe_50k/1": token_count("byte_bpe_50k"), "byte_bpe_multi_50k/1": token_count("byte_bpe_multi_50k"), "words/1": word_count}


def counted(docs: DataFrame, text: str = "text", tokenizers: dict[str, Callable[[str], int]] = TOKENIZERS, revision: Column | None = None) -> DataFrame:
    """One row (doc_id, source, lang, tokenizer, tokens) for each row of `docs` and tokenizer.
    Null sources and languages are keys like others (''); a null text has no tokens.

    With a `revision` of the text there are two more columns: whether it differs from the text,
    and its tokens. Texts are read once and do not leave their task; one that does not change is
    counted once."""
    t = F.coalesce(F.col(text), F.lit(""))
    new = F.lit(None).cast("string") if revision is None else F.nullif(F.coalesce(revision, F.lit("")), t)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("source", "lang")]
    rows = docs.select("doc_id", *key, t.alias("t"), new.alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, news = b["t"].to_pylist(), b["new"].to_pylist()
            for name, count in tokenizers.items():
                before = [count(x) for x in texts]
                after = [n if x is None else count(x) for n, x in zip(before, news, strict=True)]
                own = [pa.array([name] * len(before)), pa.array(before, pa.int64()), pa.array([x is not None for x in news]), pa.array(after, pa.int64())]
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], b["lang"], *own], names=["doc_id", "source", "lang", "tokenizer", "tokens", "changed", "revised"])

    rows = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, source string, lang string, tokenizer string, tokens long, changed boolean, revised long")
    return rows.drop("changed", "revised") if revision is None else rows


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows for new documents."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens")


def deleted(counts: DataFrame) -> DataFrame:
    """Signed rows for documents that go, from the counts they came with."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows for documents whose counts or keys change."""
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """The totals kept in a folder; see the module's text."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self.files.exists(self.path(f"{self.folder}/{name}"))

    def batches(self) -> list[str]:
        """Ids of the committed batches, sorted."""
        if not self.files.exists(self.path(self.folder)):
            return []
        names = (s.getPath().getName() for s in self.files.listStatus(self.path(self.folder)))
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Commits the signed rows of a batch; False if the batch was committed before, and
        then nothing is read or changed. Rows without effect are dropped."""
        if not BATCH.fullmatch(batch):
            raise ValueError(f"batch id {batch!r}")
        if self._there(f"batch={batch}") or self._folded(batch):
            return False
        sums = signed.groupBy(*KEYS).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS))
        staging = f"{self.folder}/_staging/{batch}-{uuid.uuid4().hex}"
        sums.where(" OR ".join(f"{c} <> 0" for c in SUMS)).write.parquet(staging)
        return self._renamed(staging, f"batch={batch}")

    def _renamed(self, staging: str, name: str) -> bool:
        """One of several writers of a name wins; the others' work goes."""
        fs, source, target = self.spark._jvm.org.apache.hadoop.fs, self.path(staging), self.path(f"{self.folder}/{name}")
        context = fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # unlike FileSystem's, this rename fails where the target exists
            context.rename(source, target, self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
        except Py4JJavaError:
            if not self._there(name):
                raise
            self.files.delete(source, True)
            return False
        return True

    def _bases(self) -> list[str]:
        """Names of the compacted tables; the last holds all that earlier ones do."""
        if not self.files.exists(self.path(self.folder)):
            return []
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.path(self.folder)) if s.getPath().getName().startswith("base="))

    def _folded_ids(self) -> list[str]:
        bases = self._bases()
        if not bases:
            return []
        return [r[0] for r in self.spark.read.parquet(f"{self.folder}/{bases[-1]}/ids").collect()]  # one row a batch

    def _folded(self, batch: str) -> bool:
        bases = self._bases()
        return bool(bases) and not self.spark.read.parquet(f"{self.folder}/{bases[-1]}/ids").where(F.col("batch") == batch).isEmpty()

    def deltas(self, batches: list[str] | None = None) -> DataFrame:
        """All signed rows in force: the last base and, of the given batches (default: all),
        those it does not hold."""
        bases, folded = self._bases(), set(self._folded_ids())
        paths = [f"{self.folder}/{bases[-1]}/rows"] if bases else []
        paths += [f"{self.folder}/batch={b}" for b in (self.batches() if batches is None else batches) if b not in folded]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self, batches: list[str] | None = None) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys whose documents are all gone are left
        out."""
        sums = self.deltas(batches).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return sums.where(" OR ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Folds all committed batches into a new base, committed by one rename; the folded
        batches' folders are removed after it, and ignored if that is cut short."""
        batches = self.batches()  # one that is committed from now on waits for the next call
        ids = sorted({*self._folded_ids(), *batches})
        bases = self._bases()
        number = int(bases[-1].removeprefix("base=")) + 1 if bases else 0
        staging = f"{self.folder}/_staging/base-{uuid.uuid4().hex}"
        self.totals(batches).write.parquet(f"{staging}/rows")
        self.spark.createDataFrame([(b,) for b in ids], "batch string").coalesce(1).write.parquet(f"{staging}/ids")
        if self._renamed(staging, f"base={number:08d}"):
            for name in [f"batch={b}" for b in ids] + bases:
                self.files.delete(self.path(f"{self.folder}/{name}"), True)


#: Runs of marks that a cleaning revision of a corpus takes out of texts.
MARKS = r"[%$#*&]{3,}"


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents: they are loaded; those labelled toxic are
    deleted; of the others, texts are revised by taking out runs of marks; and the second
    batch is sent again, without effect."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rows = staged(counted(docs, revision=F.regexp_replace("text", MARKS, "")), "token-counts")
    rollup = Rollup(spark, work_folder(spark, "token-rollup"))
    gone = deleted(rows.join(toxic, "doc_id", "left_semi"))
    changed = rows.where("changed").join(toxic, "doc_id", "left_anti")
    rollup.commit("0001-load", inserted(rows))
    rollup.commit("0002-toxic", gone)
    rollup.commit("0003-marks", revised(changed, changed.withColumn("tokens", F.col("revised"))))
    rollup.commit("0002-toxic", gone)
    rollup.compact()
    return rollup.totals()
