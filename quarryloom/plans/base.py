"""How queries are registered, and the inputs that both engines derive alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# classes for DuckDB's regular expressions, as in functions.text
SP = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJ = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3001}-\x{303F}\x{FF01}-\x{FFEF}]"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(x: str) -> str:
    cjk, space = f"len(regexp_extract_all({x}, '{CJ}'))", f"len(regexp_extract_all({x}, '{SP}'))"
    return f"CAST(ceil({cjk} * 0.9::DOUBLE + (length({x}) - {cjk} - {space}) / 3.8::DOUBLE) AS BIGINT)"


def conv_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, md (all turns), prev (without the last): a heading for each turn, of levels 1 to 5 in turn."""
    turn = F.struct("turn", F.concat(F.repeat(F.lit("#"), (F.col("turn") % 5 + 1).cast("int")), F.lit(" "), F.col("role"), F.lit("\n\n"), F.col("text")).alias("t"))
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("p"))
    joined = lambda p: F.array_join(F.transform(p, lambda x: x["t"]), "\n\n")
    return parts.select("conv_id", joined(F.col("p")).alias("md"), joined(F.slice("p", 1, F.size("p") - 1)).alias("prev"))


SQL_CONV = """
conv_turns AS (SELECT conv_id, turn, repeat('#', CAST(turn % 5 + 1 AS INT)) || ' ' || role || chr(10) || chr(10) || text AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
conv_md AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS md,
  coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (back > 1), '') AS prev FROM conv_turns GROUP BY conv_id)"""


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with md: each line a block."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("md"))


SQL_BLOCKS = """
doc_md AS (SELECT doc_id, source, replace(text, chr(10), chr(10) || chr(10)) AS md FROM documents),
doc_rows AS (SELECT doc_id, unnest(b) AS block, unnest(range(len(b))) AS pos FROM (
  SELECT doc_id, list_filter(string_split(md, chr(10) || chr(10)), lambda x: regexp_replace(x, '{SP}', '', 'g') <> '') AS b FROM doc_md))""".replace("{SP}", SP)


def sql_sections(source: str, key: str, md: str, name: str) -> str:
    """CTEs for the sections of source.md, as closed forms over heading lines (no fences in these texts)."""
    return f"""
{name}_l AS (SELECT {key}, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT {key}, string_split({md}, chr(10)) AS l FROM {source})),
{name}_h AS (SELECT {key}, i, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\\s+(.*)$', 1)) AS heading,
  row_number() OVER (PARTITION BY {key} ORDER BY i) AS n FROM {name}_l WHERE regexp_matches(line, '^#{{1,6}}\\s+')),
{name}_e AS (SELECT h.*, (SELECT min(k.i) FROM {name}_h k WHERE k.{key} = h.{key} AND k.i > h.i AND k.level <= h.level) AS stop,
  (SELECT min(k.i) FROM {name}_h k WHERE k.{key} = h.{key} AND k.i > h.i AND k.level <= 4) AS own_stop FROM {name}_h h WHERE h.level <= 4),
{name}_whole AS (SELECT {key}, {md} AS t FROM {source} s WHERE regexp_replace({md}, '{SP}', '', 'g') <> '' AND NOT EXISTS (SELECT 1 FROM {name}_h h WHERE h.{key} = s.{key})),
{name} AS (
  SELECT e.{key}, CAST(n - 1 AS INT) AS ord, 's' || n AS id, CAST(level AS INT) AS level, heading,
    (SELECT string_agg(line, chr(10) ORDER BY l.i) FROM {name}_l l WHERE l.{key} = e.{key} AND l.i >= e.i AND (stop IS NULL OR l.i < stop)) AS content,
    regexp_replace((SELECT string_agg(line, chr(10) ORDER BY l.i) FROM {name}_l l WHERE l.{key} = e.{key} AND l.i >= e.i AND (own_stop IS NULL OR l.i < own_stop)), '^{SP}+|{SP}+$', '', 'g') AS own,
    coalesce((SELECT string_agg(a.heading, ' › ' ORDER BY a.i) FROM {name}_h a WHERE a.{key} = e.{key} AND a.i < e.i AND a.level < e.level
      AND NOT EXISTS (SELECT 1 FROM {name}_h b WHERE b.{key} = e.{key} AND b.i > a.i AND b.i < e.i AND b.level <= a.level)), NULL) AS path
  FROM {name}_e e
  UNION ALL SELECT {key}, 0, 's1', 1, '(見出しなし)', t, t, NULL FROM {name}_whole)"""
