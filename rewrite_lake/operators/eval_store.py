"""Corpus metrics kept up to date by input part (AGG-06, RPT-01).

Every metric of :func:`metrics.evaluate_pairs` is a function of sums: ten BLEU
counts, rows, non-toxic rows, fluent rows and cosines.  The store is a table of
such sums, one row per input part and group, and grows by *deltas*:

* a new part adds its sums;
* a replaced part adds its new sums and subtracts what the store holds of it;
* a part that goes only subtracts.

Totals are sums of deltas, so the texts of parts that did not change are never
read again.  All sums are exact (counts, and cosines in decimal units of 1e-12), so
order and grouping of the changes can't show in the result, and a subtraction
leaves nothing behind.

A change is written to a folder of its own, named by its number.  A folder without
Spark's ``_SUCCESS`` is not read, and the same number written again replaces the
folder, so a change that fails half-way is simply repeated.  ``compact`` writes the
sums of all folders as one base; readers then start there.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bleu as B
from ..session import stored
from .metrics import score_outputs

#: Cosines are summed as whole numbers of this many units.
UNITS = 10 ** 12

#: The sums of one part and group.
SUMS = ("n", *B.STATS_FIELDS, "non_toxic", "fluent", "cosine_units")
_FOLDER = re.compile(r"(base|delta)-(\d{12})$")
_WIDE = "decimal(38,0)"


def part_statistics(rows: DataFrame, part: str = "part", by: Sequence[str] = (), source: str = "toxic",
                    reference: str = "neutral1", output: str = "model_output", threshold: float = 0.5) -> DataFrame:
    """The sums of ``rows`` per ``part`` and group ``by``: one aggregate.

    Rows with a NULL text count nothing (FLT-01), but their part and group keep
    a row of zeros: a part whose rows are all incomplete is known, and empty.
    """
    whole = F.col(source).isNotNull() & F.col(reference).isNotNull() & F.col(output).isNotNull()
    texts = [F.when(whole, F.col(c)).otherwise(F.lit("")).alias(a)
             for c, a in ((source, "__source"), (reference, "__reference"), (output, "__output"))]
    df = rows.select(F.col(part).alias("__part"), F.struct(*[F.col(b) for b in by], F.lit(0).alias("__none")).alias("__by"),
                     whole.cast("bigint").alias("__whole"), *texts)
    df = score_outputs(df, "__source", "__reference", "__output", threshold)
    units = F.round(F.col("__sim") * F.lit(float(UNITS))).cast("decimal(20,0)")
    values = {"n": F.col("__whole"), **{f: F.col("__bleu")[f] for f in B.STATS_FIELDS},
              "non_toxic": F.col("__non_toxic"), "fluent": F.col("__fl"), "cosine_units": units}
    sums = [F.coalesce(F.sum(F.when(F.col("__whole") == 1, v)), F.lit(0)).cast(_WIDE).alias(k) for k, v in values.items()]
    out = df.groupBy("__part", "__by").agg(*sums)
    return out.select(F.col("__part").alias(part), *[F.col("__by")[b].alias(b) for b in by], *SUMS)


def bundle(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n, BLEU, STA, SIM, FL, J`` per group from rows of sums; groups without a
    row are left out (one row, with NULL means, when there are no groups)."""
    agg = sums.groupBy(*by).agg(*[F.sum(k).alias(k) for k in SUMS])
    if by:
        agg = agg.where("n > 0")
    n = F.when(F.col("n") > 0, F.col("n").cast("double"))

    def mean(name: str, scale: float = 1.0) -> Column:
        return F.col(name).cast("double") / n / F.lit(scale)

    agg = agg.withColumns({"STA": mean("non_toxic"), "SIM": mean("cosine_units", float(UNITS)), "FL": mean("fluent")})
    return agg.select(*by, F.coalesce(F.col("n").cast("bigint"), F.lit(0).cast("bigint")).alias("n"),
                      B.corpus_bleu_expr().alias("BLEU"), "STA", "SIM", "FL",
                      (F.col("STA") * F.col("SIM") * F.col("FL")).alias("J"))


class EvalStore:
    """The store in folder ``path`` (a shared file system); see the module.

    ``part`` names the column of input parts, ``by`` the groups reported (a run, a
    language).  Parts and groups may be NULL.  Changes come from one writer, with
    rising numbers; the last one may be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, part: str = "part", by: Sequence[str] = (), **columns):
        self.spark, self.path, self.part, self.by, self.columns = spark, path.rstrip("/"), part, list(by), columns

    # --- folders -----------------------------------------------------------------

    def _folders(self) -> list[tuple[int, str, str]]:
        """Finished folders that count: (number, kind, path) from the last base on."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/_SUCCESS")
        found = []
        for status in pattern.getFileSystem(conf).globStatus(pattern) or []:
            folder = status.getPath().getParent().toString()
            name = _FOLDER.search(folder)
            if name:
                found.append((int(name[2]), name[1], folder))
        base = max((n for n, kind, _ in found if kind == "base"), default=-1)
        return sorted(f for f in found if f[0] > base or (f[0] == base and f[1] == "base"))

    def _read(self, before: int | None = None) -> DataFrame | None:
        folders = [p for n, _, p in self._folders() if before is None or n < before]
        return self.spark.read.parquet(*folders) if folders else None

    def _write(self, kind: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}-{number:012d}")

    def _next(self, number: int, repeatable: bool) -> None:
        last = max(((n, kind) for n, kind, _ in self._folders()), default=(-1, "base"))
        if number < last[0] or (number == last[0] and not (repeatable and last[1] == "delta")):
            raise ValueError(f"change {number} comes after {last[0]}: numbers must rise")

    # --- changes -----------------------------------------------------------------

    def _live(self, before: int | None = None) -> DataFrame | None:
        """Sums held per part and group, parts that went left out."""
        rows = self._read(before)
        if rows is None:
            return None
        live = rows.groupBy(self.part, *self.by).agg(*[F.sum(k).cast(_WIDE).alias(k) for k in SUMS])
        return live.where(F.greatest(*[F.abs(F.col(k)) for k in SUMS]) > 0)

    def change(self, number: int, rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Take the parts in ``rows`` in place of what is held of them, and drop the
        parts listed in column ``part`` of ``gone`` (others in it do nothing; a part
        in both is replaced).  Every part in ``rows`` must be there whole."""
        self._next(number, repeatable=True)
        new = touched = None
        if rows is not None:
            new = stored(part_statistics(rows, self.part, self.by, **self.columns))
            touched = new.select(self.part)
        if gone is not None:
            out = gone.select(F.col(self.part).cast(touched.schema[0].dataType) if touched is not None else F.col(self.part))
            touched = out.toDF(self.part) if touched is None else touched.union(out)
        if touched is None:
            raise ValueError("a change needs rows or parts that go")
        live = self._live(before=number)
        if live is not None:
            t = touched.distinct().withColumnRenamed(self.part, "__touched")
            old = live.join(t, F.col(self.part).eqNullSafe(F.col("__touched")), "left_semi")
            old = old.select(self.part, *self.by, *[(-F.col(k)).cast(_WIDE).alias(k) for k in SUMS])
            new = old if new is None else new.unionByName(old)
        if new is not None:
            self._write("delta", number, new)

    def add(self, number: int, rows: DataFrame) -> None:
        """Rows more of parts, old or new: their sums are merged, nothing is replaced."""
        self._next(number, repeatable=True)
        self._write("delta", number, part_statistics(rows, self.part, self.by, **self.columns))

    def compact(self, number: int) -> None:
        """One base folder in place of all folders so far, which stay on disk unread."""
        self._next(number, repeatable=False)
        live = self._live()
        if live is not None:
            self._write("base", number, live)

    # --- reading -----------------------------------------------------------------

    def parts(self) -> DataFrame:
        """The sums held, one row per part and group."""
        live = self._live()
        if live is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return live

    def metrics(self, by: Sequence[str] | None = None) -> DataFrame:
        """The bundle per group (all of the store's, or those of ``by``) over what is
        held now; ``by=[part]`` reports parts."""
        by = self.by if by is None else list(by)
        rows = self._read()
        if rows is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return bundle(rows, by)
