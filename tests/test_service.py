"""The HTTP service over a real socket."""

import json
import threading
import urllib.error
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from rollcall import service as s


@pytest.fixture
def served(spark, tmp_path):
    (tmp_path / "samples").mkdir()
    (tmp_path / "samples" / "hr_one.json").write_text(json.dumps({"full_name": "Bo Dean", "email": "bo@x.co"}))
    (tmp_path / "secret_resume.json").write_text(json.dumps({"name": "Not Asked"}))
    server = ThreadingHTTPServer(("127.0.0.1", 0), s.handler(s.Service(spark, samples=str(tmp_path / "samples"), folder=str(tmp_path / "out"))))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", tmp_path
    server.shutdown()
    server.server_close()


def ask(url, body=None, kind="application/x-www-form-urlencoded"):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": kind} if body is not None else {}), timeout=300) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def multipart(fields, files):
    out = b""
    for name, value in fields.items():
        out += f'--X\r\nContent-Disposition: form-data; name="{name}"\r\n\r\n{value}\r\n'.encode()
    for name, content in files:
        out += f'--X\r\nContent-Disposition: form-data; name="files"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + content + b"\r\n"
    return out + b"--X--\r\n"


def test_config_and_samples(served):
    url, _ = served
    status, config = ask(url + "/api/config")
    assert status == 200 and len(config["fields"]) == 16 and {"path": "emails", "from": "emails[*]"} in config["fields"]
    assert [x["path"] for x in ask(url + "/api/samples")[1]] == ["hr_one.json"]
    assert ask(url + "/nothing")[0] == 404


def test_process(served):
    url, folder = served
    resume = json.dumps({"name": "Änn Lee", "email": "ann@x.co", "skills": ["Go"]}).encode()
    linkedin = json.dumps({"fullName": "Änn Lee", "emailAddress": "ANN@x.co", "headline": "Dev"}).encode()
    fields = {"samples": json.dumps(["hr_one.json", "../secret_resume.json", "none.json"]), "output_config": json.dumps({"fields": [{"path": "who", "from": "full_name"}]})}
    status, got = ask(url + "/api/process", multipart(fields, [("../a_resume.json", resume), ("b_linkedin.json", linkedin)]), "multipart/form-data; boundary=X")
    assert status == 200 and got["success"] and set(got) == {"success", "profiles", "report", "output", "logs"}
    assert [p["emails"] for p in got["profiles"]] == [["ann@x.co"], ["bo@x.co"]]
    assert [x["who"] for x in got["output"]] == ["Änn Lee", "Bo Dean"]
    assert got["report"]["summary"] == {"total_profiles": 2, "clusters_with_merges": 1} and len(got["report"]["candidates"]) == 2
    assert "2 profiles of 3 inputs" in got["logs"]
    assert (folder / "out" / "bo_dean.json").exists()


def test_process_without_inputs_and_with_broken_lists(served):
    url, _ = served
    assert ask(url + "/api/process", b"samples=%5Bbroken&urls=3") == (400, {"success": False, "error": "No input files were provided."})


def test_too_large_a_form_is_refused(served, monkeypatch):
    monkeypatch.setattr(s, "MOST", 10)
    assert ask(served[0] + "/api/process", b"x" * 11)[0] == 413


def test_a_failed_run_says_why(served, monkeypatch):
    def broken(*_):
        raise RuntimeError("no luck")

    monkeypatch.setattr(s, "run", broken)
    status, got = ask(served[0] + "/api/process", b"samples=%5B%22hr_one.json%22%5D")
    assert status == 500 and got["error"] == "no luck" and "the run failed" in got["logs"]


@pytest.mark.parametrize(("given", "name"), [("../../a b.json", "a_b.json"), ("C:\\x\\cv.pdf", "cv.pdf"), ("..", "upload"), (".hidden", "hidden")])
def test_safe_names(given, name):
    assert s.safe_name(given) == name
