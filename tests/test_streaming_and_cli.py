"""Arriving documents, and the command line."""

import json
import subprocess
import threading
import urllib.error
import urllib.request

import pytest

from specloom import api, cli
from specloom.serve import server
from specloom.streaming import arrivals


def test_arrivals(spark, tree, tmp_path):
    adoc = next(tree.rglob("Validation.adoc")).read_text()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.adoc").write_text(adoc)
    docs = arrivals.read_folder(spark, str(tmp_path / "in"))
    assert docs.isStreaming and arrivals.sentences(docs).isStreaming
    arrivals.numbered(docs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/b.adoc").write_text("## Trust\n\nA second validator shall check the trust list again.\n")
    arrivals.numbered(docs, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = {(r.doc, r.rule_id, r.severity) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("a.adoc", "VAL-TRUS-0001", "must_not"), ("a.adoc", "VAL-TRUS-0002", "should"), ("a.adoc", "VAL-CONT-0001", "may"), ("b.adoc", "VAL-TRUS-0001", "shall")}


def test_list_versions(capsys):
    assert cli.main(["list-versions"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == "VersionDate" and lines[2].split() == ["2.4", "2026-04-01"] and len(lines) == 14


def test_bad_arguments(tmp_path):
    for args in (["generate", "--version=v2.4", f"--spec-source={tmp_path}", "--output-dir", "x"], ["generate", "--version=2.4", "--spec-source", str(tmp_path / "no"), "--output-dir", "x"], []):
        with pytest.raises(SystemExit) as e:
            cli.main(args)
        assert e.value.code == 2


def test_generate_and_query(spark, tree, tmp_path, capsys):
    out = str(tmp_path)
    assert cli.main(["generate", "--version=2.4", "--spec-source", str(tree), "--output-dir", out, "--no-checkout"]) == 0
    assert json.loads((tmp_path / "spec-version.json").read_text())["spec_version"] == "2.4"
    capsys.readouterr()
    assert cli.main(["query", "--output-dir", out, "--version=2.4", "--entity", "ClaimMap"]) == 0
    assert json.loads(capsys.readouterr().out)["entity"]["name"] == "ClaimMap"
    assert cli.main(["diff", "--output-dir", out, "--from", "1.0", "--to", "2.4"]) == 1


def test_serve(spark, tree, tmp_path):
    assert cli.main(["generate", "--version=2.4", "--spec-source", str(tree), "--output-dir", str(tmp_path), "--no-checkout"]) == 0
    with server(api.Catalog(spark, tmp_path), 0) as web:
        threading.Thread(target=web.serve_forever, daemon=True).start()

        def post(body, path="/mcp"):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{web.server_port}{path}", body if isinstance(body, bytes) else json.dumps(body).encode())) as r:
                    return r.status, json.loads(r.read() or "null")
            except urllib.error.HTTPError as e:
                return e.code, json.loads(e.read() or "null")

        def ask(method, **params):
            status, answer = post({"jsonrpc": "2.0", "id": 7, "method": method, "params": params})
            assert status == 200 and answer["id"] == 7
            return answer.get("result") or answer["error"]

        said = lambda tool, **a: (r := ask("tools/call", name=tool, arguments=a), r["isError"] or json.loads(r["content"][0]["text"]))[1]
        assert ask("initialize")["serverInfo"]["name"] == "specloom" and post({"jsonrpc": "2.0", "method": "notifications/initialized"}) == (202, None)
        assert {t["name"] for t in ask("tools/list")["tools"]} == {"query_entity", "query_validation_rules", "diff_versions", "search_entities"}
        assert said("query_entity", version="2.4", name="ClaimMap")["entity"]["name"] == "ClaimMap" and "ClaimMap" in said("query_entity", version="2.4", name="No")["available_entities"]
        assert said("search_entities", version="2.4", query="claimm")["count"] == 1 and said("query_validation_rules", version="2.4", phase="trust")["phase"] == "trust"
        assert said("diff_versions", from_version="2.4", to_version="2.4")["summary"]["entities_added"] == 0
        assert said("query_entity", version="2.4") is True and said("search_entities", version="1.0", query="x") is True
        read = lambda uri: json.loads(ask("resources/read", uri=uri)["contents"][0]["text"])
        assert len(read("spec://versions")) == 12 and "ClaimMap" in read("spec://2.4/entities")["entities"] and read("spec://2.4/entity/ClaimMap")["entity"]["name"] == "ClaimMap"
        assert len(ask("resources/list")["resources"]) == 1 and len(ask("resources/templates/list")["resourceTemplates"]) == 2
        assert ask("resources/read", uri="spec://2.4/entity/No")["code"] == -32602 and ask("nothing")["code"] == -32601
        assert post(b"{")[0] == 400 and post({}, "/x")[0] == 404
        web.shutdown()


def test_a_failing_checkout_is_reported(tree, tmp_path, capsys):
    subprocess.run(["git", "init", "-q", str(tmp_path / "repo")], check=True)
    assert cli.main(["generate", "--version=2.4", "--spec-source", str(tmp_path / "repo"), "--output-dir", str(tmp_path)]) == 1
    assert "version 2.4 failed" in capsys.readouterr().err
