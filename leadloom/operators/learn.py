"""A text classifier for two labels: TF-IDF of words and word pairs, balanced logistic regression, cross-validation and careful relabelling.

A feature is a hash of a term, a model a weight per feature; idf and weights of all features are bounded by FEATURES and are broadcast. Each
text is one row of features and counts, written once. A step of the fit reads those rows in a bounded number of tasks; each task gives its
part of the gradient, a row per feature, and Spark sums them up. So no step moves texts or their features, and what it does
move is bounded. Nothing of the size of the corpus passes through the driver. The models of all folds are fitted in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.text import bound

#: Features that terms are hashed to; no term is left out for its rank.
FEATURES = 1 << 20
#: The feature that all texts have.
INTERCEPT = -1
#: Features of texts that are looked at at once, but for one longer text.
AT_ONCE = 1 << 20


def training_rows(rows: DataFrame, least_chars: int = 20, label: str = "label", text: str = "text") -> DataFrame:
    """Labelled rows with enough text; y is the label as a number, 0 or 1."""
    return rows.where(F.col(label).isNotNull() & (F.length(F.trim(text)) >= least_chars)).select("*", F.col(label).cast("double").alias("y"))


def terms(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours among them."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)

    def with_pairs(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))

    return bound(words, with_pairs)


def counted(rows: DataFrame, id_col: str, text: str = "text", features: int = FEATURES, *more: Column) -> DataFrame:
    """id, feature (a list) and n (how often each occurs) of each text, and more aggregates; texts of one id are one text. Texts without a term and null ids are left out."""
    grouped = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.collect_list(text).alias("texts"), *more)
    hashed = F.flatten(F.transform("texts", lambda t: F.transform(terms(t), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))))
    texts = grouped.withColumn("all", hashed).drop("texts")
    kinds = texts.drop("all")
    names = kinds.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, found in _parts(batch, "all"):
                key, n = np.unique(at * features + found, return_counts=True)
                cuts = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * features), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (key % features, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *lists], [*names, "feature", "n"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.schema]
    return texts.where(F.size("all") > 0).mapInArrow(count, ", ".join([*kept, "feature array<int>", "n array<int>"]))


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about AT_ONCE values in a column of lists: the slice, and of each value its row and itself."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = 0
    while first < len(sizes):
        last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), AT_ONCE, side="right")))
        part = batch.slice(first, last - first)
        yield part, np.repeat(np.arange(last - first), sizes[first:last]), part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        first = last


def _each(models: int, column: Callable[[int], Column], name: str) -> list[Column]:
    return [column(m).alias(f"{name}{m}") for m in range(models)]


def _rated(part: pa.RecordBatch, at: np.ndarray, feature: np.ndarray, idf: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of one model's features (tf times idf, of length 1 per text) and the texts' margins; the last weight is the intercept's."""
    x = (1 + np.log(part.column("n").flatten().to_numpy(zero_copy_only=False))) * idf[feature]
    norm = np.sqrt(np.bincount(at, x * x, part.num_rows))
    x /= np.where(norm > 0, norm, 1.0)[at]
    return x, np.bincount(at, x * weights[feature], part.num_rows) + weights[-1]


def _summed(vectors: DataFrame, models: int, features: int, add: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """What add puts into an array [model, feature] for all texts (features is the intercept): a part in each task, summed by Spark. The array is bounded by the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, features + 1))
        for batch in batches:
            for part, at, feature in _parts(batch, "feature"):
                add(part, at, feature, total)
        some = np.flatnonzero(total.any(axis=0))
        for k in range(0, len(some), 1 << 16):
            here = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), *(pa.array(total[m, here]) for m in range(models))], ["feature", *(f"g{m}" for m in range(models))])

    # As many tasks as there are cores: each gives a row per feature at most, however long the table.
    spread = vectors.coalesce(vectors.sparkSession.sparkContext.defaultParallelism)
    rows = spread.mapInArrow(run, ", ".join(["feature int", *(f"g{m} double" for m in range(models))]))
    return _dense(rows.groupBy("feature").agg(*_each(models, lambda m: F.sum(f"g{m}"), "g")), "g", models, features)


def _dense(table: DataFrame, name: str, models: int, features: int) -> np.ndarray:
    """Columns of a table by feature as an array [model, feature]; the intercept comes last."""
    found = table.select("feature", *(f"{name}{m}" for m in range(models))).toArrow()
    out = np.zeros((models, features + 1))
    # The intercept's place is the last, also where it is written as -1.
    place = found["feature"].to_numpy()
    for m in range(models):
        out[m, place] = found[f"{name}{m}"].to_numpy()
    return out


@dataclass
class Classifier:
    """Weights and idf per feature, of one or more models (columns w0, idf0...), in a table."""

    table: DataFrame
    models: int
    text: str
    features: int

    def margins(self, rows: DataFrame, id_col: str) -> DataFrame:
        """id and z0, z1...: above 0 the label is 1. A text without a known term has the intercept alone, one without any term isn't there."""
        models = self.models
        shared = rows.sparkSession.sparkContext.broadcast([_dense(self.table, name, models, self.features) for name in ("idf", "w")])
        vectors = counted(rows, id_col, self.text, self.features)

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, weights = shared.value
            for batch in batches:
                for part, at, feature in _parts(batch, "feature"):
                    z = [_rated(part, at, feature, idf[m], weights[m])[1] for m in range(models)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, z)], ["id", *(f"z{m}" for m in range(models))])

        kind = vectors.schema["id"].dataType.simpleString()
        return vectors.select("id", "feature", "n").mapInArrow(rate, ", ".join([f"id {kind}", *(f"z{m} double" for m in range(models))]))


def train(rows: DataFrame, id_col: str, path: str, least: int = 100, text: str = "text", min_df: int = 3, max_df: float = 0.9, features: int = FEATURES, steps: int = 12, penalty: float = 0.01, folds: int = 0) -> Classifier:
    """A fitted model of rows (see training_rows); refuses fewer than least rows. With folds, model k is fitted without the rows of fold k.

    Terms in fewer than min_df texts or a larger share than max_df weigh nothing. Classes weigh the same. The loss is the mean logistic
    loss with penalty / 2 times the squared weights; it falls by accelerated gradient steps. Texts' features and the model are tables below path.
    """
    models, spark = max(folds, 1), rows.sparkSession
    labels = rows.select("y", (F.pmod(F.xxhash64(id_col), F.lit(folds)) if folds else F.lit(-1)).alias("fold"))
    inside = lambda m: F.col("fold") != m
    counts = labels.agg(*_each(models, lambda m: F.count_if(inside(m)), "n"), *_each(models, lambda m: F.count_if(inside(m) & (F.col("y") == 1)), "p"))
    sizes = counts.first()
    if min(sizes[f"n{m}"] for m in range(models)) < least:
        raise ValueError(f"{min(sizes[f'n{m}'] for m in range(models))} labelled rows, {least} are needed")

    def share(m: int) -> tuple[float, float]:
        """Weights of a row of either class in model m, such that both weigh half of the rows, over their number."""
        n, p = sizes[f"n{m}"], sizes[f"p{m}"]
        return (n / (2.0 * (n - p)) if n > p else 1.0) / n, (n / (2.0 * p) if p else 1.0) / n

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
        return part.column(name).to_numpy(zero_copy_only=False)

    # A text's rows of either label: more than one where rows repeat an id.
    found = counted(rows, id_col, text, features, F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") != 1).alias("zeros"))
    fold = (F.pmod(F.xxhash64("id"), F.lit(folds)) if folds else F.lit(-1)).cast("int")
    vectors = kept(found.select(fold.alias("fold"), "ones", "zeros", "feature", "n"), "vectors")

    def texts_with(part: pa.RecordBatch, at: np.ndarray, feature: np.ndarray, total: np.ndarray) -> None:
        times = (numbers(part, "ones") + numbers(part, "zeros")).astype(np.float64)
        for m in range(models):
            total[m] += np.bincount(feature, np.where(numbers(part, "fold") != m, times, 0.0)[at], features + 1)

    df = _summed(vectors, models, features, texts_with)
    n = np.array([[sizes[f"n{m}"]] for m in range(models)])
    idf = np.where((df >= min_df) & (df <= max_df * n), np.log((n + 1) / (df + 1)) + 1, 0.0)
    idf[:, features] = 0.0
    shares = [share(m) for m in range(models)]
    weights = before = np.zeros((models, features + 1))
    scale = spark.sparkContext.broadcast(idf)
    for step in range(steps):
        # Steps are taken from beyond the weights, in the direction of the last move. Vectors have length sqrt(2), so 2 is a safe rate.
        ahead = weights + step / (step + 3.0) * (weights - before)
        shared = spark.sparkContext.broadcast(ahead)

        def slopes(part: pa.RecordBatch, at: np.ndarray, feature: np.ndarray, total: np.ndarray, shared=shared) -> None:
            for m in range(models):
                x, z = _rated(part, at, feature, scale.value[m], shared.value[m])
                p = 1 / (1 + np.exp(-np.clip(z, -700.0, 700.0)))
                error = np.where(numbers(part, "fold") != m, shares[m][1] * numbers(part, "ones") * (p - 1) + shares[m][0] * numbers(part, "zeros") * p, 0.0)
                total[m] += np.bincount(feature, x * error[at], features + 1)
                total[m, features] += error.sum()

        slope = _summed(vectors, models, features, slopes)
        slope[:, :features] += penalty * ahead[:, :features]
        weights, before = ahead - 2.0 * slope, weights
        shared.destroy()
    scale.destroy()
    used = np.append(np.flatnonzero(idf.any(axis=0)), features)
    columns = {"feature": np.where(used == features, INTERCEPT, used)} | {f"{name}{m}": x[m, used] for name, x in (("idf", idf), ("w", weights)) for m in range(models)}
    return Classifier(kept(spark.createDataFrame(pa.table(columns)), "model"), models, text, features)


def cross_validated(rows: DataFrame, id_col: str, path: str, folds: int = 5, **options) -> DataFrame:
    """Per fold (by a hash of the id): rows that were left out, and the share of them that the model without them predicts right."""
    model = train(rows, id_col, path, folds=folds, **options)
    fold = F.pmod(F.xxhash64(id_col), F.lit(folds))
    rated = rows.select(F.col(id_col).alias("id"), "y", fold.alias("fold")).join(model.margins(rows, id_col), "id")
    own = F.coalesce(*[F.when(F.col("fold") == m, F.col(f"z{m}")) for m in range(folds)])
    return rated.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(((own > 0) == (F.col("y") == 1)).cast("double")), 4).alias("accuracy"))


def scored(model: Classifier, rows: DataFrame, id_col: str) -> DataFrame:
    """id, predicted label and confidence. A text without a term isn't scored."""
    z = F.col("z0")
    return model.margins(rows, id_col).select(F.col("id").alias(id_col), (z > 0).cast("int").alias("predicted"), F.round(1 / (1 + F.exp(-F.abs(z))), 6).alias("confidence"))


# Parts of words by which texts are rated where no model is there.
AGENCY_TOKENS = (
    "imobiliaria", "imobiliária", "remax", "kw", "century", "era", "zome", "predimed", "habivida", "savills", "engel", "volkers", "sotheby", "century21", "knight", "consultor", "consultora", "mediadora",
    "sociedade", "lda", "unipessoal", "s.a", "ami", "amplitude",
)
OWNER_TOKENS = ("particular", "proprietario", "proprietário", "dono", "vendo direta", "diretamente", "sem intermediarios", "sem intermediários", "venda direta", "negociavel", "negociável")


def by_rules(rows: DataFrame, id_col: str, text: str = "text", agency: str | None = None) -> DataFrame:
    """Where no model is there: 1 (an agency) or 0 (an owner), and how sure that is: by an agency's name, else by tokens in the text; nothing found counts for an owner."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))

    def holds(tokens: tuple[str, ...]) -> Column:
        return t.rlike("|".join(x.replace(".", r"\.") for x in tokens))

    named = F.trim(F.coalesce(F.col(agency), F.lit(""))) != "" if agency else F.lit(False)
    seller = holds(AGENCY_TOKENS)
    return rows.select(id_col, (named | seller).cast("int").alias("predicted"), F.when(named, 0.85).when(seller | holds(OWNER_TOKENS), 0.7).otherwise(0.5).alias("confidence"))


def relabelled(rows: DataFrame, predictions: DataFrame, id_col: str, threshold: float = 0.80) -> DataFrame:
    """What becomes of each label: changed only with confidence, if it differs and isn't locked."""
    both = rows.join(predictions, id_col)
    outcome = F.when(F.col("locked"), "locked").when(F.col("predicted").eqNullSafe(F.col("label")), "same").when(F.col("confidence") < threshold, "uncertain").otherwise("changed")
    return both.select(id_col, "label", "predicted", "confidence", outcome.alias("outcome"))


def flips(outcomes: DataFrame) -> DataFrame:
    """Per outcome, and for changes per label before and after: how many rows."""
    changed = F.col("outcome") == "changed"
    return outcomes.groupBy("outcome", F.when(changed, F.col("label")).alias("before"), F.when(changed, F.col("predicted")).alias("after")).agg(F.count("*").alias("n"))
