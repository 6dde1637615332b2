"""Every query of the subpackage on the smallest data, against its SQL where it has one."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm.queries import ORACLES, QUERIES

#: What names a row of a query without SQL, and whether the smallest data have rows.
KEYS = {
    "p1_found": ["chunk_id", "noise"],
    "p1_repaired": ["chunk_id"],
    "p3_found": ["chunk_id", "start_pos"],
    "p3_units": ["chunk_id", "unit_no"],
    "p5_found": ["chunk_id", "markup"],
    "p5_tokens": ["chunk_id", "markup"],
    "p5_cleaned": ["chunk_id"],
    "p5_templates": ["class_id"],
    "p5_slots": ["chunk_id", "slot_no"],
    "p6_pieces": ["limit_id", "chunk_id", "piece_no"],
    "p7_containers": ["limit_id", "doc_id", "piece_no"],
    "p7_fill": ["limit_id"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_each_row_once(name, spark, smallest):
    """No key is null or there twice, and nothing is lost: queries on all chunks give all chunks."""
    df = QUERIES[name](spark, smallest).select(*KEYS[name])
    n, named, distinct = df.agg(F.count(F.lit(1)), F.count(F.struct(*KEYS[name])), F.countDistinct(*KEYS[name])).first()
    assert n == named == distinct and (n > 0 or name in ("p5_templates", "p5_slots"))
    if name in ("p1_repaired", "p5_cleaned"):
        assert n == spark.read.parquet(f"{smallest}/document_chunks.parquet").select("chunk_id").distinct().count()
