"""SQL functions: fold, slug and publisher_key for queries written as text, as expressions without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shelfspark.functions import text


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """Create the functions in the session, from the tables that the Column forms use."""
    source, target, several = text._fold_tables()
    pairs = _quoted("\x1e".join(f"{k}\x1f{v}" for k, v in several.items()))
    spelled = f"array_join(transform(split(s, ''), x -> coalesce(element_at(str_to_map({pairs}, '\x1e', '\x1f'), x), x)), '')"
    wide = f"CASE WHEN s RLIKE {_quoted(text.several_class())} THEN {spelled} ELSE s END"
    fold = f"coalesce(trim(regexp_replace(lower(translate({wide}, {_quoted(source)}, {_quoted(target)})), '[^a-z0-9]+', ' ')), '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fold(s STRING) RETURNS STRING RETURN {fold}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION slug(s STRING) RETURNS STRING RETURN replace({fold}, ' ', '-')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION publisher_key(s STRING) RETURNS STRING RETURN coalesce(trim(BOTH ' .,' FROM regexp_replace(translate(lower(s), '[]', ''), '\\\\s+', ' ')), '')")
