"""Inputs derived from the driver's tables by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Derivations of the library's inputs from the given tables.
SQL = {
    "catalog": """
select p_partkey as item_idx, p_name as item_name,
 case when p_partkey % 11 = 0 then null else p_brand end as entp_name,
 case p_partkey % 10 when 0 then 'D-W' when 1 then 'dw1'
  when 2 then concat(substr(p_type,1,2),'-',cast(p_size as string))
  when 3 then '' when 4 then null when 5 then substr(p_type,1,1)
  when 6 then concat(upper(substr(p_name,1,3)),' ',cast(p_size as string))
  when 7 then cast(p_size*10 as string) when 8 then concat('W',substr(p_type,1,2))
  else concat('SC',cast(p_partkey % 97 as string)) end as print_front,
 case p_partkey % 4 when 0 then 'PAC' when 1 then cast(p_size*5 as string) when 2 then null else ' 1O ' end as print_back,
 case p_size % 5 when 0 then '원형' when 1 then '타원형' when 2 then '장방형' when 3 then '삼각형' else null end as drug_shape,
 case p_partkey % 8 when 0 then '하양' when 1 then '노랑' when 2 then '주황' when 3 then '빨강' when 4 then '연두' when 5 then '파랑' when 6 then '초록' else null end as color_class1,
 case p_partkey % 9 when 0 then '흰색' when 1 then '청색' else null end as color_class2
from part""",
    "readings": """
select o_orderkey as reading_id,
 case o_orderkey % 7 when 0 then '' when 1 then lower(base) when 2 then replace(replace(base,'0','O'),'1','I')
  when 3 then replace(base,'W','VV') when 4 then replace(base,'S','C')
  when 5 then concat('?',replace(base,'-',''),'!!') else base end as imprint_raw,
 case when o_orderkey % 5 = 0 then null else drug_shape end as shape_guess,
 case o_orderkey % 4 when 0 then '연두+하양' when 1 then null else color_class1 end as color_guess
from (select o.o_orderkey, c.*, concat(coalesce(c.print_front,''),' ',coalesce(c.print_back,'')) as base
  from orders o join catalog c on o.o_custkey = c.item_idx) t""",
    "detections": """
select l_orderkey as image_id,
 cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate) as bigint) as det_id,
 cast((l_partkey*7 + l_suppkey) % 38 as int) as class_id, l_quantity/50.0 as conf,
 cast(l_partkey*13 % 560 as int) as x0, cast(case when l_suppkey % 2 = 0 then 150 else 360 end + l_linenumber*5 as int) as y0,
 cast(l_partkey*13 % 560 + 20 + l_linenumber*3 as int) as x1,
 cast(case when l_suppkey % 2 = 0 then 190 else 400 end + l_linenumber*5 as int) as y1
from lineitem""",
    "label_boxes": """
select l_suppkey as image_id, cast(row_number() over (partition by l_suppkey order by l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_shipdate) as bigint) as det_id,
 cast((l_partkey*7 + l_suppkey) % 38 as int) as class_id,
 cast(l_partkey*13 % 560 as int) as x0, cast(l_orderkey % 400 as int) as y0,
 cast(l_partkey*13 % 560 + 20 + l_linenumber*3 as int) as x1, cast(l_orderkey % 400 + 40 as int) as y1
from lineitem""",
    "ocr_lines": """
select conv_id as roi_id, cast(turn % 6 + 1 as int) as pass_no, cast(floor(turn/6) as int) as line_no,
 text, cast((conv_id*37 + turn*11) % 100 as double)/100 as conf from conversations""",
    "ocr_attempts": "select conv_id as roi_id, turn as attempt_no, text from conversations",
    "pixels": """
select l_suppkey as roi_id, cast(l_partkey % 100 as int) as x, cast(l_orderkey % 80 as int) as y,
 cast(l_partkey % 256 as int) as b, cast(l_orderkey*3 % 256 as int) as g, cast(cast(floor(l_extendedprice) as bigint) % 256 as int) as r,
 l_returnflag <> 'R' as in_mask from lineitem""",
    "contours": """
select l_orderkey as image_id, cast(1600 as int) as img_w, cast(1200 as int) as img_h,
 cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate) as bigint) as box_id,
 cast(l_partkey*17 % 1200 as int) as x, cast(l_suppkey*29 % 800 as int) as y,
 cast(l_quantity*12 as int) as w, cast(60 + l_partkey % 300 as int) as h,
 l_quantity*12*(60 + l_partkey % 300)*0.75 as area, 2*(l_quantity*12 + 60 + l_partkey % 300)*0.9 as perimeter
from lineitem""",
    "raw_texts": "select doc_id, text from documents",
    "snapshots": """
select o_orderkey as version, case when o_orderkey % 7 = 0 then null else cast(o_orderkey * 3600.0 as double) end as loaded_at
from orders""",
}
NEEDS = {"readings": ("catalog",)}
TABLES = ("part", "orders", "lineitem", "conversations", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; only the tables it names are read."""
    sql = SQL[name]
    sources = {}
    for source in (*NEEDS.get(name, ()), *TABLES):
        for before in ("from ", "join "):
            if before + source in sql:
                sql = sql.replace(before + source, f"{before}{{{source}}}")
                sources[source] = load(spark, sf_dir, source) if source in SQL else table(spark, sf_dir, source)
    return spark.sql(sql, **sources)


def with_ctes(*names: str, more: str = "") -> str:
    """A WITH clause with the fixtures, for DuckDB."""
    out: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        own = f"{name} as ({SQL[name]})"
        if own not in out:
            out.append(own)

    for name in names:
        add(name)
    return "with " + ",\n".join(out + ([more] if more else [])) + "\n"
