"""Fetching from a server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tombola.plans import scans
from tombola.sources import history, web
from tombola.sources.schema import Dims

ROWS = [{"loteria": "A", "juego": "J", "fecha": f"2020-01-{k % 28 + 1:02d}", "numeros": [k % 100, "2", "x"]} for k in range(25)]


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        self.seen.append(self.path)
        if self.path.startswith("/blocks/2020-01-02") or self.path == "/blocks/2020-01-03" and self.seen.count(self.path) == 1:
            self.send_error(500)
            return
        if self.path.startswith("/blocks"):
            self.answer('<div class="game-block x"><a class="game-title" href="/nacional/q">Gana</a><span class="score">7</span><span class="score">08</span></div>')
            return
        if self.path == "/archive":
            self.answer('<option value="2009-12">a<option value="2020-02">b<option value="2020-01">c')
            return
        if self.path.startswith("/day/2020-01-02"):
            self.send_error(500)
            return
        if self.path.startswith("/strict") and int(self.headers["Range"].split("-")[0]) >= len(ROWS):
            self.send_error(416)
            return
        if self.path.startswith(("/feed", "/strict")):
            first, last = map(int, self.headers["Range"].split("-"))
            found = [r for r in ROWS if "lottery=neq.A" not in self.path]
            body = json.dumps((found[::-1] if "order=fecha.desc" in self.path else found)[first : last + 1])
        else:
            body = f"<p>{self.path}</p>"
        self.answer(body)

    def answer(self, body):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_POST(self):
        if self.path.startswith("/tables"):
            month = self.rfile.read(int(self.headers["Content-Length"])).decode().removeprefix("month=")
            self.answer(f"<tr><td>05/{month[5:]}/{month[:4]}</td><td>Tarde</td><td>1 2 3</td></tr>")
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(self.rfile.read(int(self.headers["Content-Length"])))

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_a_page_a_day_and_failures_stop_nothing(spark, server):
    out = {r["day"]: r for r in web.pages(web.days(spark, "2020-01-01", "2020-01-03"), "day", server + "/day/{}", tasks=2).collect()}
    assert set(out) == {"2020-01-01", "2020-01-02", "2020-01-03"}
    assert out["2020-01-01"]["html"] == "<p>/day/2020-01-01</p>" and out["2020-01-02"]["html"] is None and "500" in out["2020-01-02"]["error"]
    posted = web.pages(web.days(spark, "2020-01-01", "2020-01-01"), "day", server + "/month", form="m={}").head()
    assert posted["html"] == "m=2020-01-01"


@pytest.mark.parametrize("rows, stripes", [(10, 2), (25, 3), (7, 1)])
def test_feed_is_read_whole(spark, server, rows, stripes):
    feed = web.read_feed(spark, server + "/feed", pageRows=str(rows), stripes=str(stripes))
    draws = history.from_feed(feed, server).collect()
    assert sorted(r["numbers"][0] for r in draws) == list(range(25)) and {len(r["numbers"]) for r in draws} == {2}


def test_a_server_that_refuses_ranges_past_the_end(spark, server):
    assert web.read_feed(spark, server + "/strict", pageRows="5", stripes="3").count() == 25
    assert web.read_feed(spark, server + "/feed", order="fecha.desc", filter="lottery=neq.A").count() == 0
    first = web.read_feed(spark, server + "/feed", order="fecha.desc", pageRows="100", stripes="1").head()
    assert first["numeros"][0] == "24"


DIMS = Dims(start="2010-01-01", slugs=(("nacional", "Nacional"),))


def test_a_scan_fetches_once_retries_and_lists_what_failed(spark, server, tmp_path):
    Handler.seen.clear()
    rows, failed = scans.scan_days(spark, "2020-01-01", "2020-01-04", server + "/blocks/{}", str(tmp_path / "a"), DIMS, tasks=2)
    for _ in range(2):  # what is landed is read, not fetched again
        assert sorted((str(r["draw_date"]), r["lottery"], r["numbers"]) for r in rows.collect()) == [(f"2020-01-0{d}", "Nacional", [7, 8]) for d in (1, 3, 4)]
        assert [(r["key"], "500" in r["error"]) for r in failed.collect()] == [("2020-01-02", True)]
    assert [sum(p.endswith(f"-0{d}") for p in Handler.seen) for d in (1, 2, 3, 4)] == [1, 2, 2, 1]
    assert scans.scan_day(spark, "2020-01-01", server + "/blocks/{}", str(tmp_path / "b"), DIMS, session="Other", tasks=1)[0].count() == 0


def test_months_of_an_archive_and_all_sources(spark, server, tmp_path):
    ends = (("A", server + "/tables/{}"), ("B", server + "/tables?m={}"), ("C", "http://127.0.0.1:9/{}"))
    months = lambda: scans.scan_months(spark, server + "/archive", ends, str(tmp_path / "m"), tasks=1)
    rows, failed = months()
    assert sorted((r["lottery"], str(r["draw_date"]), r["numbers"]) for r in rows.collect()) == [(x, f"2020-0{m}-05", [1, 2, 3]) for x in "AB" for m in (1, 2)]
    assert sorted(r["key"] for r in failed.collect()) == ["2020-01", "2020-02"]

    def gone():
        raise OSError("no such host")

    days = lambda: scans.scan_days(spark, "2020-01-01", "2020-01-02", server + "/blocks/{}", str(tmp_path / "d"), DIMS, tasks=1)
    rows, failed = scans.scan_all(spark, {"days": days, "gone": gone, "months": months})
    assert sorted(r["lottery"] for r in rows.collect()) == ["A", "A", "B", "B", "Nacional"]
    assert sorted(r["key"] for r in failed.collect()) == ["days/2020-01-02", "gone", "months/2020-01", "months/2020-02"]
