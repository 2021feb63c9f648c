"""HTTP service for small runs: ``python -m rollcall.service --port 5000``.

GET /api/config names the default output configuration, GET /api/samples lists the sample files. POST
/api/process takes a form (multipart or urlencoded) with ``files``, ``samples`` (a JSON list of names),
``urls`` (a JSON list) and ``output_config`` (JSON), runs over them and answers {success, profiles, report,
output, logs}. The answer holds every profile, so it is for runs of a form's size; larger ones use
the command line or Spark's writers.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import re
import threading
from contextlib import contextmanager
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config, read_json
from .operators import projection
from .plans.pipeline import Result, run
from .shared import shared_dir
from .sinks import report_rows, write_candidates
from .sources.remote import Transport, http

log = logging.getLogger("rollcall")

#: Bytes of a form that are accepted.
MOST = 64 << 20
# Profile paths of the default output configuration; lists are marked.
LISTS = ["emails", "phones", "links.other", "skills", "experience", "education"]
PATHS = [
    "candidate_id", "full_name", "emails", "phones", "location.city", "location.region", "location.country", "links.linkedin",
    "links.github", "links.portfolio", "links.other", "headline", "years_experience", "skills", "experience", "education",
]


class LogCapture(logging.Handler):
    """Keeps the lines logged by the thread that made it."""

    def __init__(self):
        super().__init__()
        self.thread, self.lines = threading.get_ident(), []
        self.setFormatter(logging.Formatter("%(asctime)s [%(levelname)-5s] %(name)s: %(message)s", "%H:%M:%S"))

    def emit(self, record: logging.LogRecord) -> None:
        if record.thread == self.thread:
            self.lines.append(self.format(record) + "\n")

    def text(self) -> str:
        return "".join(self.lines)


@contextmanager
def captured():
    """A LogCapture on the root logger, whose level is INFO meanwhile."""
    root, handler = logging.getLogger(), LogCapture()
    level = root.level
    root.addHandler(handler)
    root.setLevel(logging.INFO)
    try:
        yield handler
    finally:
        root.removeHandler(handler)
        root.setLevel(level)


def default_output() -> dict:
    fields = [{"path": p, "from": p + "[*]" * (p in LISTS)} for p in PATHS]
    return {"fields": fields, "include_confidence": True, "include_provenance": True, "on_missing": "null"}


def samples_in(folder: str) -> list[dict]:
    """{name, path, size} of the files below a folder, by path; dot files are left out."""
    out = []
    for at, _, names in os.walk(folder):
        for name in names:
            if not name.startswith("."):
                path = os.path.join(at, name)
                out.append({"name": name, "path": os.path.relpath(path, folder).replace(os.sep, "/"), "size": os.path.getsize(path)})
    return sorted(out, key=lambda s: s["path"])


def sample_path(folder: str, name: str) -> str | None:
    """A sample's full path; None if it is missing or lies outside the folder."""
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, name))
    return path if path.startswith(root + os.sep) and os.path.isfile(path) else None


def safe_name(name: str) -> str:
    """The last part of a path with other characters than letters, digits, dot, - and _ as _."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", re.split(r"[/\\]", name)[-1]).lstrip("._") or "upload"


def form(content_type: str, body: bytes) -> tuple[dict[str, str], list[tuple[str, bytes]]]:
    """(fields, uploaded files) of a form."""
    if not content_type.lower().startswith("multipart/form-data"):
        return {k: v[-1] for k, v in parse_qs(body.decode("utf-8", "replace")).items()}, []
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + content_type.encode("latin-1") + b"\r\n\r\n" + body)
    fields, files = {}, []
    for part in message.iter_parts():
        name, file = part.get_param("name", header="content-disposition"), part.get_filename()
        content = part.get_payload(decode=True) or b""
        if file:
            files.append((file, content))
        elif name and file is None:
            fields[name] = content.decode("utf-8", "replace")
    return fields, files


def json_list(text: str | None) -> list[str]:
    """The strings of a JSON list that are not blank; none, with an error logged, of anything else."""
    try:
        found = json.loads(text) if text else []
        if not isinstance(found, list):
            raise ValueError("not a list")
    except ValueError as e:
        log.error("a list can't be read: %s", e)
        return []
    return [x.strip() for x in found if isinstance(x, str) and x.strip()]


def saved(spark: SparkSession, files: list[tuple[str, bytes]], folder: str) -> list[str]:
    """Write uploads below a folder that the executors share, each in its own; returns their paths."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for i, (name, content) in enumerate(files):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}/{safe_name(name)}")
        system = path.getFileSystem(conf)
        stream = system.create(path, True)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        out.append(system.makeQualified(path).toString())
    return out


def answer(result: Result, output: dict | None) -> dict:
    """{profiles, report, output} of a run, as JSON values."""
    whole = F.to_json(F.struct(*[c for c in result.profiles.columns if c != "cluster_id"]), {"ignoreNullFields": "false"})
    profiles = [json.loads(r["json"]) for r in result.profiles.orderBy("cluster_id").select(whole.alias("json")).toLocalIterator()]
    rows = [(r["part"], json.loads(r["json"])) for r in report_rows(result).toLocalIterator()]
    report = {"summary": next(x for part, x in rows if part == 0), "candidates": [x for part, x in rows if part == 1]}
    return {"profiles": profiles, "report": report, "output": [json.loads(r["json"]) for r in projection.to_json(result.output, output).toLocalIterator()]}


class Service:
    """What the requests do; ``samples``: folder of sample files, ``folder``: where each profile's files go."""

    def __init__(self, spark: SparkSession, *, samples: str = "sample_data", folder: str | None = None, config: Config | None = None, transport: Transport | None = None):
        self.spark, self.samples, self.folder, self.config, self.transport = spark, samples, folder, config, transport

    def process(self, content_type: str, body: bytes) -> tuple[int, dict]:
        """(status, answer): 400 without an input, 500 for a failed run."""
        with captured() as logs:
            uploads = None
            try:
                fields, files = form(content_type, body)
                uploads = f"{shared_dir(self.spark)}/uploads"
                paths = saved(self.spark, files, uploads)
                paths += [p for name in json_list(fields.get("samples")) if (p := sample_path(self.samples, name))]
                paths += json_list(fields.get("urls"))
                if not paths:
                    return 400, {"success": False, "error": "No input files were provided."}
                output = None
                if fields.get("output_config"):
                    try:
                        output = json.loads(fields["output_config"])
                    except ValueError as e:
                        log.error("the output configuration can't be read: %s", e)
                result = run(self.spark, paths, self.config, output, self.transport)
                found = answer(result, output)
                if self.folder:
                    write_candidates(result, self.folder)
                log.info("%d profiles of %d inputs", len(found["profiles"]), len(paths))
                return 200, {"success": True, **found, "logs": logs.text()}
            except Exception as e:
                log.exception("the run failed")
                return 500, {"success": False, "error": str(e), "logs": logs.text()}
            finally:
                if uploads:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(uploads)
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, content) -> None:
            body = json.dumps(content).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path == "/api/config":
                self.reply(200, read_json(os.path.join("config", "output_config.json")) or default_output())
            elif self.path == "/api/samples":
                self.reply(200, samples_in(service.samples))
            else:
                self.reply(404, {"success": False, "error": "not found"})

        def do_POST(self) -> None:
            size = self.headers.get("Content-Length", "")
            if self.path != "/api/process":
                self.reply(404, {"success": False, "error": "not found"})
            elif not size.isdigit() or int(size) > MOST:
                self.close_connection = True
                self.reply(413 if size.isdigit() else 411, {"success": False, "error": f"a form of a stated length of at most {MOST} bytes is expected"})
            else:
                self.reply(*service.process(self.headers.get("Content-Type", ""), self.rfile.read(int(size))))

        def log_message(self, form: str, *values) -> None:
            log.debug(form, *values)

    return Handler


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rollcall.service")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=5000)
    p.add_argument("--samples", default="sample_data", help="folder of sample files")
    p.add_argument("--output", default="output", help="folder for a JSON file per profile")
    p.add_argument("--pipeline-config", help="settings of the run (JSON)")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("rollcall").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    service = Service(spark, samples=args.samples, folder=args.output, config=Config.load(args.pipeline_config), transport=http)
    ThreadingHTTPServer((args.host, args.port), handler(service)).serve_forever()


if __name__ == "__main__":
    main()
