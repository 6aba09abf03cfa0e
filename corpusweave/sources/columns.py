"""Name a key column ``text`` for processing and restore the original columns afterwards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusweave.plans.staging import stage


@dataclass(frozen=True)
class TextColumns:
    """Which original columns are ``text`` and ``id``, and the order to restore."""

    columns: tuple[str, ...]
    text_key: str = "text"
    id_key: str = "id"

    @classmethod
    def of(cls, df: DataFrame, text_key: str = "text", id_key: str = "id") -> TextColumns:
        for key, name in ((text_key, "text"), (id_key, "id")):
            if key != name and key in df.columns and name in df.columns:
                raise ValueError(f"column {name!r} is already taken, cannot rename {key!r}")
        return cls(tuple(df.columns), text_key, id_key)

    def assign(self, df: DataFrame, source: str = "rows") -> DataFrame:
        """Rename the key columns; a missing text column is ``""``, a missing id is numbered."""
        if self.text_key in df.columns:
            df = df.withColumnRenamed(self.text_key, "text")
        else:
            df = df.withColumn("text", F.lit(""))
        if self.id_key in df.columns:
            return df.withColumnRenamed(self.id_key, "id")
        try:
            # A Parquet file knows the place of its rows, so nothing needs to be written.
            place = F.concat_ws("/", F.lit(source), "_metadata.file_path", "_metadata.row_index")
            return df.withColumn("id", place)
        except AnalysisException:
            # Other numbers are only stable once written: a task run again could differ.
            number = F.monotonically_increasing_id().cast("string")
            return stage(df.withColumn("id", F.concat(F.lit(f"{source}/"), number)), "numbered")

    def restore(self, df: DataFrame, keep_added: bool = False) -> DataFrame:
        """Original columns in original order, then, on request, those added since."""
        renamed = {"text": self.text_key, "id": self.id_key}
        current = {renamed.get(c, c): c for c in df.columns}
        names = [c for c in self.columns if c in current]
        if keep_added:
            names += [c for c in current if c not in names]
        return df.select(*[F.col(current[c]).alias(c) for c in names])


def _as_text(field: T.StructField) -> Column:
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(field.name))
    return F.col(field.name).cast("string")


def to_documents(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """View a table with ``text`` and ``id`` as ``text, id, media, metadata``.

    A ``metadata`` column may be a map or JSON text; text that is no JSON object is kept
    under the key ``metadata``.  All other columns join the map and win over its keys.
    """
    schema = df.schema
    rest = [f for f in schema.fields if f.name not in ("text", "id", "media", metadata)]
    own = F.create_map(*[x for f in rest for x in (F.lit(f.name), _as_text(f))]) if rest else None
    given = None
    if metadata in df.columns:
        given = F.col(metadata)
        if isinstance(schema[metadata].dataType, T.StringType):
            parsed = F.from_json(given, "map<string,string>")
            is_object = F.ltrim(given).startswith("{") & parsed.isNotNull()
            given = F.when(is_object, parsed).when(
                given.isNotNull(), F.create_map(F.lit("metadata"), given)
            )
        given = F.coalesce(given, F.create_map().cast("map<string,string>"))
    if own is None:
        merged = given if given is not None else F.create_map().cast("map<string,string>")
    elif given is None:
        merged = own
    else:
        names = [f.name for f in rest]
        merged = F.map_concat(F.map_filter(given, lambda k, _: ~k.isin(names)), own)
    media = F.col("media") if "media" in df.columns else F.array().cast("array<string>")
    return df.select("text", "id", media.alias("media"), merged.alias("metadata"))
