"""A run over an invented portal: what is asked, what is stored, and going on after a failure."""

import json

import pytest

from ratlas.sources import folders, portal

BASE = "https://x.example/r/"
MONTH = BASE + "si0040.asp"


def test_a_run_over_months(spark, tmp_path):
    def month(*rows):
        cell = "<tr><td><span class=weekday>{0}.</span><td class=silink><div class=smc-el-h>{1}</div><a class=smc-link-normal href='si0057.asp?__ksinr={2}'>Runde {2}</a></tr>"
        return "<table id=smc_page_si0040_contenttable1>" + "".join(cell.format(*r) for r in rows) + "</table>"

    def detail(k):
        return (
            f"<div class=smc-documents><div class=smc-dg-ds-1><div class=smc-doc-content><a href='getfile.asp?id=own{k}'>Mitschrift</a></div></div></div>"
            f"<table class=Tagesordnung><tr><td>Ö 1<td>Lichter<td>vertagt<td><a href='getfile.asp?id=both'>Plan</a><tr><td>Ö 2<td>Deich<td>-<td><a href='getfile.asp?id=gone{k}'>Skizze</a></table>"
        )

    log = tmp_path / "log"

    def fetch(url):
        with log.open("a") as f:
            f.write(url + "\n")
        if "si0040" in url:
            return (month((3, "Beirat Nordufer", 501), (9, "Werkausschuss", 502)) if "month=11" in url else month((9, "Werkausschuss", 502), (4, "Beirat", 503))).encode(), {}
        if "si0057" in url:
            return detail(url[-3:]).encode(), {"Content-Type": "text/html"}
        if "gone" in url:
            raise OSError("404")
        return b"bytes of " + url.encode(), {"Content-Type": "application/pdf", "ETag": "e1"}

    months = spark.createDataFrame([(2019, 11), (2019, 12), (2019, 11)], "year int, month int")
    run = portal.Run(spark, f"file://{tmp_path}/run", fetch, BASE, MONTH, attempts=1)
    broken = portal.Run(spark, f"file://{tmp_path}/run", lambda url: fetch(url) if "getfile" not in url else 1 / 0 if url.endswith("never") else fetch(url), BASE, MONTH, attempts=1)
    broken.documents = lambda *_: (_ for _ in ()).throw(OSError("machine lost"))
    with pytest.raises(OSError, match="machine lost"):
        broken.run(months)
    asked = log.read_text().split()
    assert len(asked) == len(set(asked)) == 2 + 3  # two months, three sessions
    out = run.run(months)
    asked = log.read_text().split()
    assert len(asked) == len(set(asked)) == 2 + 3 + 7  # and seven documents, one of which all sessions name
    assert sorted((r.session_id, r.date, r.folder) for r in out["sessions"].collect()) == [
        ("501", "2019-11-03", "2019/11/2019-11-03-Beirat-Nordufer-501"), ("502", "2019-11-09", "2019/11/2019-11-09-Werkausschuss-502"), ("503", "2019-12-04", "2019/12/2019-12-04-Beirat-503"),
    ]
    docs = out["documents"].collect()
    assert len(docs) == 9 and {r.error for r in docs} == {None, "404"} and out["agenda"].count() == 6
    files = {str(p.relative_to(tmp_path / "run/files")): p.read_bytes() for p in (tmp_path / "run/files").rglob("*") if p.is_file() and not p.name.startswith(("_", "."))}
    assert len(files) == 3 + 6
    for name, content in files.items():
        if name.endswith("manifest.json"):
            told = json.loads(content)
            assert [d["sha1"] is not None and d["etag"] for d in told["documents"]] == ["e1", "e1"]
            assert all(f"{name.rpartition('/')[0]}/{d['path']}" in files for d in told["documents"])
    again = run.run(months)  # nothing is fetched or written a second time
    assert log.read_text().split() == asked and again["documents"].count() == 9
    assert {str(p.relative_to(tmp_path / "run/files")) for p in (tmp_path / "run/files").rglob("*") if p.is_file() and not p.name.startswith(("_", "."))} == set(files)
    index = folders.local_index(folders.session_folders(folders.raw_files(spark, f"file://{tmp_path}/run/files")))
    assert index[0].count() == 3 and index[2].count() == 6
