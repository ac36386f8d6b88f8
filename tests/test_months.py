import datetime as dt
import random

from pyspark.sql import functions as F

from ratlas.operators import sessions
from ratlas.sources import html_tables
from ratlas.sources.keyed import KeyedTable
from ratlas.streaming import months


def page(ids):
    rows = "".join(f"<tr><td><span class=weekday>{1 + i % 27}.</span></td><td class=silink><div class=smc-el-h>Beirat {i}</div><a class='smc-link-normal' href='si0057.asp?__ksinr={i}'>Runde {i}</a></td></tr>" for i in ids)
    return f"<table id=smc_page_si0040_contenttable1>{rows}</table>"


def test_first_page_of_a_session_wins(spark, tmp_path):
    rnd, day = random.Random(9), dt.datetime(2019, 11, 1)
    pages = [(n, 2019, 11, page(rnd.sample(range(30), 6)), day + dt.timedelta(hours=n)) for n in range(12)]
    land, target, check = (f"file://{tmp_path}/{x}" for x in ("land", "sessions", "check"))
    put = lambda rows: spark.createDataFrame(rows, months.PAGES).coalesce(1).write.mode("append").parquet(land)
    table = KeyedTable(spark, target, months.SESSIONS, "session_id")
    for part in (pages[:4], pages[4:8], pages[8:]):  # the stream stops and starts again between the parts
        put(part)
        months.follow(spark, land, target, check, "https://x.example/").awaitTermination()
        seen = spark.createDataFrame(pages[: pages.index(part[-1]) + 1], months.PAGES)
        want = sessions.first_seen(html_tables.overview_sessions(seen, "https://x.example/"), "page_id", "place")
        key = lambda df: sorted((r.session_id, r.page_id, r.date) for r in df.collect())
        assert key(table.read()) == key(want)
    put([(90, 2019, 11, page([3]), day - dt.timedelta(days=30))])  # later than the watermark: left out
    put([(91, 2020, 2, page([40]), day + dt.timedelta(days=80))])
    months.follow(spark, land, target, check, "https://x.example/").awaitTermination()
    assert table.read().where(F.col("page_id") == 90).count() == 0 and table.read().where("session_id = '40'").count() == 1
