"""Landing and reading raw rows: deltas, queues, imports, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import ACCENTED, PLAIN, present

# Names of import columns.
SYNONYMS = {
    "contact_name": ("name", "nome", "fullname", "full_name", "cliente"), "contact_phone": ("phone", "telefone", "tel", "tlm", "telemovel", "mobile", "telef", "telefon"),
    "contact_email": ("email", "e-mail", "mail"), "contact_whatsapp": ("whatsapp", "wa", "wpp"), "title": ("title", "titulo", "imovel"),
    "description": ("description", "descricao", "obs", "observacoes", "notes", "notas", "comentario", "comentarios"), "zone": ("zone", "zona", "concelho", "municipio"),
    "parish": ("parish", "freguesia"), "address": ("address", "morada", "endereco", "rua"), "price": ("price", "preco", "valor", "valor_pedido"),
    "typology": ("typology", "tipologia", "tipo"), "area_m2": ("area", "area_m2", "m2", "metros", "areautil"), "agency_name": ("agency", "agency_name", "agencia", "imobiliaria"),
    "is_owner": ("is_owner", "owner", "particular", "proprietario"), "url": ("url", "link", "anuncio"),
}
SEPARATORS = (",", ";", "\t", "|")


def parsed(raw: DataFrame, schema: str, column: str = "raw_data") -> DataFrame:
    """A JSON payload as typed columns; what can't be parsed is NULL and kept in corrupt."""
    rows = raw.withColumn("p", F.from_json(column, f"{schema}, corrupt string", {"columnNameOfCorruptRecord": "corrupt"}))
    return rows.select(*raw.columns, "p.*")


def unseen(batch: DataFrame, landed: DataFrame) -> DataFrame:
    """Rows whose (source, external_id) isn't landed, once each (the smallest id); rows without an id always."""
    known = batch.where("external_id is not null")
    first = known.groupBy("source", "external_id").agg(F.min("id").alias("id"))
    fresh = first.join(landed.select("source", "external_id").where("external_id is not null").distinct(), ["source", "external_id"], "left_anti")
    return fresh.select("id", "source", "external_id").unionByName(batch.where("external_id is null").select("id", "source", "external_id"))


def queue(landed: DataFrame, processed: DataFrame, source: str | None = None, limit: int = 1000) -> DataFrame:
    """The oldest rows that aren't processed."""
    rows = landed if source is None else landed.where(F.col("source") == source)
    return rows.join(processed.select("id"), "id", "left_anti").orderBy("scraped_at", "id").limit(limit)


def known_ids(landed: DataFrame) -> DataFrame:
    return landed.where("external_id is not null").select("source", "external_id").distinct()


def landed_today(landed: DataFrame, as_of: str) -> DataFrame:
    day = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    return landed.where(F.col("scraped_at") >= day).groupBy("source").agg(F.count("*").alias("n"))


def novelty(batch: DataFrame, landed: DataFrame, stop: float = 0.85) -> DataFrame:
    """Per batch the share of rows whose id is known, and whether it reaches the stop ratio."""
    seen = known_ids(landed).withColumn("seen", F.lit(1.0))
    share = batch.where("external_id is not null").join(seen, ["source", "external_id"], "left").groupBy("batch_id").agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("known_share"), F.count("*").alias("n"))
    return share.select("batch_id", "n", F.round("known_share", 4).alias("known_share"), (F.col("known_share") >= stop).alias("stop"))


def _key(name: str) -> str:
    folded = name.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return "".join(c for c in folded if c.isascii() and c.isalnum())


def column_map(headers: Sequence[str], synonyms: dict[str, Sequence[str]] = SYNONYMS) -> dict[str, str]:
    """header -> canonical name; the first header of a canonical name wins."""
    by_word = {_key(w): name for name, words in reversed(synonyms.items()) for w in words}
    named = [(h, by_word[_key(h)]) for h in headers if _key(h) in by_word]
    first = dict((name, h) for h, name in reversed(named))
    return {h: name for h, name in named if first[name] == h}


def canonical(rows: DataFrame, synonyms: dict[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """Imported rows by canonical names; what isn't mapped and not empty goes to raw as JSON."""
    mapping = column_map(rows.columns, synonyms)
    rest = [c for c in rows.columns if c not in mapping]
    quoted = lambda c: F.col(f"`{c}`").cast("string")
    raw = F.to_json(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*map(quoted, rest))), lambda _, v: present(v))) if rest else F.lit("{}")
    return rows.select(*[F.col(f"`{h}`").alias(n) for h, n in mapping.items()], raw.alias("raw"))


def separator_of(head: Sequence[str]) -> str:
    """The separator found most often in the first lines."""
    return max(SEPARATORS, key=lambda s: sum(line.count(s) for line in head))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file, folder or glob with a header, its separator found from the head; file is its origin."""
    head = [r.value for r in spark.read.text(path).limit(5).collect()]
    return spark.read.csv(path, header=True, sep=separator_of(head), encoding=encoding, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def actionable(rows: DataFrame) -> DataFrame:
    """Imported rows with a way to reach someone, or with a subject to look into: a title, zone or address."""
    contact = present(F.col("contact_phone")) | present(F.col("contact_email"))
    place = present(F.col("title")) | present(F.col("zone")) | present(F.col("address"))
    return rows.where(contact | place)


def upserted(existing: DataFrame, incoming: DataFrame, key: str, version: Column) -> DataFrame:
    """All keys with the row of the highest version; of equal versions the incoming row."""
    both = existing.withColumn("src", F.lit(0)).unionByName(incoming.withColumn("src", F.lit(1)), allowMissingColumns=True)
    best = F.max_by(F.struct(*[c for c in both.columns if c != "src"]), F.struct(version, "src")).alias("r")
    return both.groupBy(key).agg(best).select("r.*")


def write_csv(df: DataFrame, path: str, mask: Sequence[str] = ()) -> None:
    """A CSV sink; masked columns are written as digests."""
    for c in mask:
        df = df.withColumn(c, F.sha2(F.col(c).cast("string"), 256))
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON sink, one row a line; nested columns stay nested."""
    df.write.mode("overwrite").json(path)


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """Imports with different columns as one table; what a part lacks is NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, as a min that starts map-side, so that no key's rows are sorted in one task."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def write_sheets(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("sheet").parquet(path)
