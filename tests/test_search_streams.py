import datetime
import json
import os

import pytest

from likerec.plans import serving
from likerec.streaming.searches import read_reusable_searches, stream_reusable_searches
from tests.conftest import rows

SEARCHES = "request_id long, position int, ts timestamp_ntz, query string"
LOOKUPS = "query string, ts timestamp_ntz, hit boolean"
START = datetime.datetime(2024, 1, 1)
COLUMNS = ("request_id", "position", "ts", "query", "lookup_ts", "hit")


def at(hours):
    return START + datetime.timedelta(hours=hours)


# One list per file: (request, position, hour, query) and (query, hour, hit).
ASKED = [[(1, 0, 1, "a"), (1, 1, 1, "b"), (2, 0, 20, "a"), (2, 1, 20, None)],
         [(3, 0, 30, "c"), (4, 0, 26, "b"), (5, 0, 170, "a")],
         [(6, 0, 172, "a"), (7, 0, 171, "c"), (8, 0, 171, "never"), (8, 1, 171, "c")],
         [(9, 0, 3000, "closing")]]
FOUND = [[("a", 0, True), ("b", 1, False), ("a", 1, True)],
         [("c", 30, False), ("c", 30, True), ("a", 2, True), (None, 3, True), ("b", 27, True)],
         [("c", 170, False), ("a", 169, True), ("a", 173, False)],
         [("closing", 3000, True)]]


def put(folder, number, records):
    folder.mkdir(exist_ok=True)
    file = folder / f"{number}.json"
    file.write_text("\n".join(json.dumps(r) for r in records))
    os.utime(file, (1_700_000_000 + 60 * number,) * 2)


def searched(number):
    return [{"request_id": r, "position": p, "ts": at(h).isoformat(), "query": q} for r, p, h, q in ASKED[number]]


def looked_up(number):
    return [{"query": q, "ts": at(h).isoformat(), "hit": hit} for q, h, hit in FOUND[number]]


def run(spark, folder, sources, spread=8):
    sides = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).json(str(f)) for s, f in zip((SEARCHES, LOOKUPS), sources)]
    query = stream_reusable_searches(*sides, f"{folder}/answers", f"{folder}/progress", available_now=True, spread=spread)
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None


@pytest.mark.parametrize("spread", [1, 8])
def test_two_streams_with_a_restart_equal_the_batch(spark, tmp_path, spread):
    sources = tmp_path / "searches", tmp_path / "lookups"
    for first, last in ((0, 2), (2, 4)):
        for number in range(first, last):
            put(sources[0], number, searched(number))
            put(sources[1], number, looked_up(number))
        run(spark, tmp_path, sources, spread)
    everything = [[r for part in parts for r in part] for parts in (ASKED, FOUND)]
    whole = serving.reusable_searches(
        spark.createDataFrame([(r, p, at(h), q) for r, p, h, q in everything[0]], SEARCHES),
        spark.createDataFrame([(q, at(h), hit) for q, h, hit in everything[1]], LOOKUPS))
    got = read_reusable_searches(spark, f"{tmp_path}/answers")
    expected = rows(whole, *COLUMNS)
    assert rows(got, *COLUMNS) == expected and len(expected) == 11
    by_search = {r[:2]: r[4:] for r in expected}
    # Beside each other: reused, too old an empty one, a later lookup that is not used, none at all.
    assert by_search[1, 0] == (at(1), True) and by_search[4, 0] == (None, None) and by_search[6, 0] == (at(169), True)
    assert by_search[5, 0] == (at(169), True) and by_search[8, 0] == (None, None)
    one_day = read_reusable_searches(spark, f"{tmp_path}/answers", days=("2024-01-08", "2024-01-08"))
    assert rows(one_day, *COLUMNS) == [r for r in expected if r[2].date() == datetime.date(2024, 1, 8)]


def test_no_rows_at_all(spark, tmp_path):
    sources = tmp_path / "searches", tmp_path / "lookups"
    for source in sources:
        source.mkdir()
    run(spark, tmp_path, sources)
    assert read_reusable_searches(spark, f"{tmp_path}/answers").count() == 0


def test_a_query_that_fills_both_streams_makes_no_pairs(spark, tmp_path):
    """30,000 searches for one name, each with a lookup of its own: 450 million pairs would not end in time. A search without a
    position and a lookup without an outcome are among them."""
    n = 30_000
    sources = tmp_path / "searches", tmp_path / "lookups"
    moments = spark.range(n).selectExpr("id request_id", "0 position", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) ts", "'hot' query")
    moments.selectExpr("request_id", "nullif(position, int(request_id % 1000)) position", "ts", "query").write.json(str(sources[0]))
    moments.selectExpr("query", "ts", "CASE WHEN request_id % 7 > 0 THEN request_id % 2 = 0 END hit").write.json(str(sources[1]))
    sides = [spark.readStream.schema(s).json(str(f)) for s, f in zip((SEARCHES, LOOKUPS), sources)]
    query = stream_reusable_searches(*sides, f"{tmp_path}/answers", f"{tmp_path}/progress", available_now=True)
    query.awaitTermination(60)
    ended = not query.isActive
    query.stop()
    assert ended and query.exception() is None
    tables = [spark.read.schema(s).json(str(f)) for s, f in zip((SEARCHES, LOOKUPS), sources)]
    got, whole = read_reusable_searches(spark, f"{tmp_path}/answers"), serving.reusable_searches(*tables)
    assert got.count() == n and got.exceptAll(whole.select(*got.columns)).isEmpty()
