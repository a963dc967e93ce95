"""Readers of catalog files, a query service, and streams of observations."""

import threading
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from tremorlake.sources import catalog
from tremorlake.streaming import prospective

USGS = """time,latitude,longitude,depth,mag,magType,nst,gap,dmin,rms,net,id,updated,place,type,horizontalError,depthError,magError,magNst,status,locationSource,magSource
2024-01-01T00:00:00.000Z,24.1,91.2,10.0,4.6,MB,12.7,100,,0.5,us,us1,2024,"10 km N of A, B",earthquake,5.1,1.9,,20,reviewed,us,us
2024-01-02T00:00:00.000Z,24.1,91.2,10.0,,mb,12,100,,0.5,us,us2,2024,x,earthquake,5.1,1.9,,20,reviewed,us,us
"""
ISC = """#EventID|Time|Latitude|Longitude|Depth/km|Author|Catalog|Contributor|ContributorID|MagType|Magnitude|MagAuthor|EventLocationName|EventType
1|2024-01-01T00:00:00.20|24.0|91.1|11|ISC|ISC|ISC|1|MB|4.5|ISC|here|ke
2|2024-01-01T00:00:09.20|24.0|91.1|11|auto|ISC|ISC|1|mb|NaN|ISC|here|ke
# footer
"""


def test_csv_and_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(USGS)
    (tmp_path / "b.txt").write_text(ISC)
    a = catalog.read_usgs_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["native_event_id"], r["magnitude_type"], r["n_stations"], r["quality_flag"]) for r in a] == [("us1", "mb", 12, "reviewed")]
    b = catalog.read_isc_text(spark, str(tmp_path / "b.txt")).collect()
    assert [(r["native_event_id"], r["original_magnitude"]) for r in b] == [("isc:1", 4.5)]


# Headers of a public format, as they are published and as they are written elsewhere.
ISCGEM = """EventID,Origin_Time,Lat,Lon,Depth,Mw,Mtype,Msigma,smaj,depth_err
1,2001-02-03 04:05:06.70,24.5,91.5,,6.1,Mw,0.2,7.5,3.1
2,2001-02-03 04:05:06,24.5,91.5,33,5.9,MS,0.3,,2
3,2001-02-03 04:05:06,,91.5,33,5.9,MS,0.3,,2
4,2001-02-03 04:05:06,24.5,91.5,33,,MS,0.3,,2
5,,24.5,91.5,33,5.9,MS,0.3,,2
"""
OTHER = """iscid,time,latitude,longitude,depth_km,m,mag_error,smin,depth_error
9,1999-12-31T23:59:59Z,20.25,90,12,5.0,0.1,4,1.5
"""


def test_iscgem_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(ISCGEM)
    (tmp_path / "b.csv").write_text(OTHER)
    names = ["native_event_id", "depth_km", "original_magnitude", "magnitude_type", "magnitude_uncertainty", "horizontal_uncertainty_km", "depth_uncertainty_km"]
    rows = lambda f: [tuple(r[n] for n in names) for r in catalog.read_iscgem_csv(spark, str(tmp_path / f)).collect()]
    assert rows("a.csv") == [("1", 0.0, 6.1, "mw_iscgem", 0.2, 7.5, 3.1), ("2", 33.0, 5.9, "ms", 0.3, None, 2.0)]
    assert rows("b.csv") == [("9", 12.0, 5.0, "mw_iscgem", 0.1, 4.0, 1.5)]


def test_geojson_and_faults(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features":[{"id":"x","properties":{"time":1704067200000,"mag":5.1,"magType":"Mww","status":"automatic"},"geometry":{"coordinates":[91.5,24.5,null]}}]}')
    r = catalog.read_usgs_geojson(spark, str(tmp_path / "a.json")).first()
    assert (r["latitude"], r["longitude"], r["depth_km"], r["magnitude_type"]) == (24.5, 91.5, 0.0, "mww")
    (tmp_path / "f.json").write_text('{"features":[{"properties":{"fault_id":"1","average_dip":"30","rake":"90","slip_rate":"-999"},"geometry":{"type":"MultiLineString","coordinates":[[[91,24],[92,25]],[[93,26]]]}}]}')
    f = catalog.read_faults_geojson(spark, str(tmp_path / "f.json")).first()
    assert len(f["trace"]) == 3 and f["slip_rate"] is None and f["confidence"] == "low"


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 4.0), ("a", "2024-01-01 00:00:00", 4.0), ("b", "2024-01-09 00:00:00", 5.0)]
    frame = spark.createDataFrame(rows, "native_event_id string, t string, original_magnitude double").selectExpr("native_event_id", "CAST(t AS TIMESTAMP) AS origin_time", "original_magnitude")
    folder = str(tmp_path / "in")
    frame.write.parquet(folder)
    stream = prospective.deduplicated(prospective.landing(spark, folder, frame.schema))
    out = str(tmp_path / "out")
    prospective.forecast_each_batch(stream, lambda b: b, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["native_event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_feed_pushes_filters_into_its_requests(spark):
    """A service that answers as it is asked, is busy at first, and holds rows without magnitude."""
    from tremorlake.sources.feed import FilteredQuakeFeed, QuakeFeed

    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events = [(f"e{k}", start + timedelta(hours=7 * k), 20 + k % 9, 88 + k % 7, round(3 + k % 30 / 10, 1) if k % 11 else "") for k in range(400)]
    asked, lock = [], threading.Lock()

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            with lock:
                asked.append(q)
                busy = len(asked) == 1
            at = lambda name: datetime.fromisoformat(q[name]).replace(tzinfo=timezone.utc)
            rows = [e for e in events if at("starttime") <= e[1] <= at("endtime") and (e[4] == "" or e[4] >= float(q.get("minmagnitude", -9))) and float(q.get("minlatitude", -90)) <= e[2] <= float(q.get("maxlatitude", 90))]
            text = "time,latitude,longitude,depth,mag,magType,nst,gap,id,status\n" + "".join(f"{e[1].isoformat().replace('+00:00', 'Z')},{e[2]},{e[3]},10,{e[4]},Mw,12.7,,{e[0]},reviewed\n" for e in rows)
            self.send_response(503 if busy else 200)
            self.end_headers()
            self.wfile.write(b"" if busy else text.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(QuakeFeed)
        spark.dataSource.register(FilteredQuakeFeed)
        loaded = lambda name="quake_feed", **more: spark.read.format(name).options(url=f"http://127.0.0.1:{server.server_port}/query", start="2024-01-01", end="2024-04-01", days="10", **more).load()
        got = loaded("filtered_quake_feed").where("original_magnitude >= 5 AND latitude < 25 AND origin_time >= '2024-02-01' AND magnitude_type = 'mw'")
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {r["native_event_id"]: r for r in got.collect()}
        want = {e[0] for e in events if e[4] != "" and e[4] >= 5 and e[2] < 25 and datetime(2024, 2, 1, tzinfo=timezone.utc) <= e[1] < datetime(2024, 4, 1, tzinfo=timezone.utc)}
        assert set(found) == want and len(want) > 30
        assert (found[min(want)]["n_stations"], found[min(want)]["quality_flag"], found[min(want)]["depth_km"]) == (12, "reviewed", 10.0)
        # What is left for Spark: the comparisons of time, magnitude and place are gone.
        left = plan.split("Filter", 1)[1].split("BatchScan")[0]
        assert "magnitude_type" in left and "= mw" in left and ">=" not in left and "<" not in left
        assert all(q["minmagnitude"] == "5.0" and q["maxlatitude"] == "25.0" and q["starttime"] >= "2024-02-01" for q in asked) and len(asked) >= 7
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        asked[:] = [{}]
        whole = [e for e in events if e[4] != "" and e[1] < datetime(2024, 4, 1, tzinfo=timezone.utc)]
        feed = loaded(minmagnitude="4.0")
        assert feed.count() == sum(e[4] >= 4 for e in whole) and len(asked) == 1 + 10 and asked[-1]["minmagnitude"] == "4.0"
        # Spark tests the rows itself, also of a frame that is used again.
        assert [feed.where(f"latitude < {x}").count() for x in (22, 26)] == [sum(e[4] >= 4 and e[2] < x for e in whole) for x in (22, 26)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()
