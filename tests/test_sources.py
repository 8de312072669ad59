"""Damaged records beside the typed ones, and a log of several schemas read as one."""

import pytest
from pyspark.sql import functions as F

from pricemill.operators import audit, cleaning
from pricemill.sources import tables

HEADER = "STORE,UPC,WEEK,MOVE,QTY,PRICE,SALE,PROFIT,OK,PRICE_HEX"
GOOD = ["2,111,1,5,1,1.99,B,25.1,1,ff", '3,112,2,0,1,0,"",.,1,', ' 4 ,113,3,7.5,1,2.5,"S,x",NA,0,é', "5,114,4,N/A,1,1,C,1,1,x"]
DAMAGED = {
    "6,115,5,1": ["columns"], "7,116,6,1,1,1,B,1,1,x,y,z": ["columns"], "8,117,7,many,1,1.0,B,1,1,x": ["type:move"], "9,118,w8,1,1,$2,B,1,300,x": ["type:week", "type:price", "type:ok"],
    ",119,9,1,1,1,B,1,1,é": ["missing:store"], "just text": ["columns"],
}


def test_every_record_is_a_row_or_damaged(spark, tmp_path):
    for name, part in (("a", slice(0, None, 2)), ("b", slice(1, None, 2))):
        lines = [HEADER, *GOOD[part], "", *list(DAMAGED)[part]]
        (tmp_path / f"{name}.csv").write_bytes("\r\n".join(lines).encode("latin-1"))
    rows, damaged = tables.checked_movement(spark, f"file://{tmp_path}/*.csv")
    found = {r["line"]: r["reasons"] for r in damaged.collect()}
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in DAMAGED.items()}
    assert damaged.select("file").distinct().count() == 2
    got = {r["upc"]: r for r in rows.collect()}
    assert rows.schema.names == tables.MOVEMENT.names and set(got) == {111, 112, 113, 114}
    assert got[113]["store"] == 4 and got[113]["sale"] == "S,x" and got[113]["profit"] is None and got[112]["sale"] is None and got[114]["move"] is None
    counts = {r["measure"]: r["value"] for r in cleaning.raw_audit(rows, damaged).collect()}
    assert (counts["rows"], counts["damaged"], counts["damaged:columns"], counts["damaged:type:price"], counts["damaged:missing:store"]) == (4, 6, 3, 1, 1)


def test_sound_files_read_as_before(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("\n".join([HEADER, *GOOD]).encode("latin-1"))
    rows, damaged = tables.checked_movement(spark, f"file://{tmp_path}/m.csv")
    key = lambda r: str(r)
    assert damaged.count() == 0 and sorted(rows.collect(), key=key) == sorted(tables.read_movement(spark, f"file://{tmp_path}/m.csv").collect(), key=key)
    (tmp_path / "short.csv").write_text("STORE,UPC\n1,2\n")
    with pytest.raises(tables.SchemaError):
        tables.checked_movement(spark, f"file://{tmp_path}/short.csv")


def test_a_log_of_three_schemas(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    with pytest.raises(tables.SchemaError):
        tables.read_log(spark, folder)
    old = spark.createDataFrame([(1, "KEEP_CURRENT"), (2, "KEEP_CURRENT")], "upc int, decision string")
    middle = spark.createDataFrame([("r3", 3, "RECOMMEND_CHANGE", 7), ("r4", 4, "KEEP_CURRENT", None)], "rec_id string, upc long, decision string, price int")
    new = spark.createDataFrame([("r5", 5, "RECOMMEND_CHANGE", 7.25, ["A"], True)], "rec_id string, upc long, decision string, price double, codes array<string>, flag boolean")
    odd = spark.createDataFrame([("r6", "six", 1.5)], "rec_id string, flag string, price float")
    for df in (old, middle, new, new, odd):
        tables.append_log(df, folder)
    log = tables.read_log(spark, folder)
    assert dict(log.dtypes) == {"upc": "bigint", "decision": "string", "rec_id": "string", "price": "double", "codes": "array<string>", "flag": "string", "schema": "string"}
    rows = log.collect()
    assert len(rows) == 7 and len({r["schema"] for r in rows}) == 4
    by = {r["upc"]: r for r in rows if r["upc"]}
    assert by[1]["rec_id"] is None and by[3]["price"] == 7.0 and by[5]["codes"] == ["A"] and by[5]["flag"] == "true"
    moved = spark.createDataFrame([("r3", "2024-01-01", "REVIEWED")], "rec_id string, transitioned_at_utc string, to_state string")
    states = {(r["upc"], r["rec_id"]): r["state"] for r in audit.current_state(log, moved).collect()}
    assert states[3, "r3"] == "REVIEWED" and states[1, None] == states[2, None] == states[5, "r5"] == "GENERATED"
    assert audit.current_state(log, moved).count() == 7
