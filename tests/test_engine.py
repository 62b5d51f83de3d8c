"""Every query against its SQL, and the engine on a small repository."""

from __future__ import annotations

import json
import subprocess

import pytest

import __spark_entry__ as entry
from docwarden import cli
from docwarden.functions import expressions as x
from docwarden.operators import chunking
from docwarden.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    return str(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted([same(r[c]) for c in columns] for r in got.collect()) == sorted([same(v) for v in r] for r in want.fetchall())


ODD_TEXTS = [None, "", "  \n", "\n", "\t", "\u00a0", "\u3000a\u2003", " a ", "a\n", "\u200b", "\\n"]


def odd_documents(folder):
    """Missing, empty and blank texts, sources and languages, wide spaces at either end, and rows without an id."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(k * len(ODD_TEXTS) + i, text, source) for k, source in enumerate(["s", None, "", " ", "\u2003s"]) for i, text in enumerate(ODD_TEXTS)]
    rows = [(doc_id, text, ("en", "de", None)[doc_id % 3], source) for doc_id, text, source in rows] + [(-3, "", "it", ""), (-4, None, "pt", None), (None, "a", "en", "s"), (None, None, "zz", "s")]
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string()}
    pq.write_table(pa.table({c: pa.array(v, kind) for (c, kind), v in zip(kinds.items(), zip(*rows))}), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["q07_embedding_text", "q08_embedding_fallback"])
def test_odd_documents_match_the_sql(spark, tmp_path, name):
    import duckdb

    odd = odd_documents(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{odd}/documents.parquet')")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted([repr(r[c]) for c in columns] for r in entry.queries()[name](spark, odd).collect()) == sorted([repr(v) for v in r] for r in want.fetchall())


def test_embedding_texts_leave_out_empty_parts(spark):
    rows = spark.createDataFrame([("h", "t"), ("h", ""), ("", "t"), (None, "t"), ("h", None), ("", None), ("\u2003h", "t\u3000")], "heading string, text string")
    got = [r[0] for r in rows.select(x.doc_embedding_text(rows.heading, rows.text)).collect()]
    assert got == ["h\\nt", "h", "t", "t", "h", "", "h\\nt"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_markdown_sections():
    text = "pre\n\n# A\nbody\n```py\n# no heading\n```\n## B\n\nSetext\n======\nend\n~~~\nopen"
    got = [(c[0], c[1], c[2], c[3], c[4], c[5]) for c in chunking.markdown_chunks(text, "x.md")]
    assert got == [("x.md (preamble)", 0, "pre", [], 1, 2), ("A", 1, "body", ["# lang: py\n# no heading\n"], 4, 7), ("A > B", 2, "", [], 9, 9), ("Setext", 1, "end", ["open\n"], 12, 14)]
    assert chunking.markdown_chunks("", "x.md") == [] and chunking.code_chunks("def f(:")[1]


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/__init__.py").write_text("def connect(host, timeout=30):\n    \"\"\"Opens a connection.\"\"\"\n    import os\n    return os.getenv('APP_TOKEN')\n\n\ndef size(items) -> int:\n    return len(items)\n")
    (root / "README.md").write_text("# Use\n\nCall `connect(host, timeout)`. The `timeout` defaults to `31`. It reads the environment variable `APP_TOKEN`.\n\n## Size\n\n`size` returns `int`.\n")
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=a", "-c", "user.email=a@example.com", "commit", "-qm", "first"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    return root


def test_whole_check_of_a_repository(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    run = lambda *args: (capsys.readouterr(), cli.main([*args], spark), capsys.readouterr().out)[2]
    with pytest.raises(SystemExit):
        run("init", str(tmp_path))
    run("init", str(repo))
    first = json.loads(run("run-all", str(repo)))
    assert first["code"]["chunks"] == 2 and first["docs"]["chunks"] == 2 and first["claims"]["signature"] == 1 and first["verification"]["total"] == 4
    rows = json.loads(run("report", str(repo), "--format", "json"))
    assert {e["claim_type"]: e["status"] for f in rows["files"].values() for e in f}["signature"] == "Verified"
    run("report", str(repo), "--output", str(tmp_path / "r.txt"))
    assert "README.md" in (tmp_path / "r.txt").read_text()
    again = json.loads(run("run-all", str(repo)))
    assert again["code"]["skipped"] == 1 and again["code"]["reprocessed"] == 0 and again["verification"] == first["verification"]
    (repo / "pkg/__init__.py").write_text("def other(): ...\n")
    changed = json.loads(run("chunk-code", str(repo)))
    assert changed["reprocessed"] == 1 and changed["chunks"] == 1
    assert json.loads(run("export-labels", str(repo), "--output", "labels.csv"))["exported"] == 2
    assert json.loads(run("score-extraction", str(repo), "--labeled", "labels.csv"))["skipped"] == 2 and "Extraction" in run("eval-summary", str(repo))


def test_fault_evaluation(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    cli.main(["init", str(repo)], spark)
    cli.main(["run-all", str(repo)], spark)
    before = (repo / "pkg/__init__.py").read_text()
    capsys.readouterr()
    cli.main(["eval-faults", str(repo), "--n-faults", "5"], spark)
    got = json.loads(capsys.readouterr().out)
    assert got["n_faults"] == got["detected"] + got["missed"] >= 1 and (repo / "pkg/__init__.py").read_text() == before


def test_commands_ask_for_what_they_need(spark, repo, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    code = lambda *args: pytest.raises(SystemExit, cli.main, [*args], spark).value.code
    assert code("embed", str(repo)) == 1
    cli.main(["init", str(repo)], spark)
    assert code("extract-claims", str(repo)) == 1 and code("retrieve", str(repo)) == 0 and code("verify", str(repo)) == 1
    (tmp_path / "config.yaml").write_text("model: some:7b\nmodel_host: http://127.0.0.1:9\n")
    cli.main(["chunk-docs", str(repo)], spark)
    assert code("extract-claims", str(repo)) == 1 and "no model service" in capsys.readouterr().err


def test_model_is_probed_and_asked():
    import http.server
    import pickle
    import threading

    from docwarden.sources import model

    class Service(http.server.BaseHTTPRequestHandler):
        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):  # noqa: N802
            self.reply({"models": [{"name": "some:7b"}]})

        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.reply({"response": f"{asked['model']} {asked['prompt']} {asked['options']['temperature']}"})

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host = f"http://127.0.0.1:{server.server_port}"
    assert model.reachable(host) and model.available("some:7b", host) and model.available("some:13b", host) and not model.available("other", host)
    assert pickle.loads(pickle.dumps(model.Model("some:7b", host)))("hello") == "some:7b hello 0.0"
    server.shutdown()
    assert not model.reachable("http://127.0.0.1:9") and not model.available("some", "http://127.0.0.1:9")
    with pytest.raises(model.ModelError):
        model.Model("some", "http://127.0.0.1:9")("x")


def test_deep_sources_are_unparsable_and_not_fatal():
    assert chunking.code_chunks("x = " + "-" * 100_000 + "1") == ([], True) and chunking.resolved("def f(a=" + "(" * 5000 + "1" + ")" * 5000 + "): ...")["resolution_method"] == "failed"
    assert chunking.code_chunks("x = " + "a." * 20_000 + "b")[1] in (True, False)
