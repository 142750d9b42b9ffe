"""The command line on projects with broken or missing configuration, and its options."""

import json

from loomspan.__main__ import main


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def said(capsys):
    return json.loads(capsys.readouterr().out)


def test_broken_configuration_is_an_error_row(spark, tmp_path, capsys):
    write(tmp_path, {"package.json": "{ not json", "tsconfig.json": '{"compilerOptions": ', "index.ts": "import './a';\n", "a.ts": "export const a = (1;\n", "b.ts": ""})
    assert main([str(tmp_path), "--json"], spark) == 0
    out = said(capsys)
    assert {(r["path"], r["code"]) for r in out["analysisErrors"]} == {("package.json", "package-json-parse-failed"), ("tsconfig.json", "tsconfig-parse-failed"), ("a.ts", "parse-recovered"), ("b.ts", "file-empty")}
    assert [r["path"] for r in out["unusedFiles"]] == ["b.ts"] and out["unusedDependencies"] == []


def test_options(spark, tmp_path, capsys):
    write(tmp_path, {"start.ts": "import { x } from '~/lib';\nexport const own = x;\n", "src/lib.ts": "export const x = 1;\nexport type T = 1;\n", "src/gen.ts": "export const g = 1;\n", "src/v.vue": "<script>import './lib'</script>"})
    assert main([str(tmp_path), "--json", "--entry", "start.ts", "--paths", "~/*=src/*", "bad", "--ignore", "src/gen.ts", "--report-types", "--include-entry-exports", "--extensions", ".ts"], spark) == 0
    out = said(capsys)
    assert {(r["path"], r["name"]) for r in out["unusedExports"]} == {("start.ts", "own"), ("src/lib.ts", "T")} and out["unusedFiles"] == []
    assert main([str(tmp_path), "--entry", "start.ts", "--fail-on-cycles"], spark) == 0
    assert "unused files" in capsys.readouterr().out


def test_flags_are_no_issue(spark, tmp_path, capsys):
    write(tmp_path, {"index.ts": "if (process.env.FEATURE_A) run();\n"})
    assert main([str(tmp_path), "--fail-on-issues", "--fail-on-cycles"], spark) == 0
    assert "FEATURE_A" in capsys.readouterr().out


def test_an_empty_folder(spark, tmp_path, capsys):
    assert main([str(tmp_path), "--json"], spark) == 0
    out = said(capsys)
    assert out["totals"][0]["files"] == 0 and not any(v for k, v in out.items() if k != "totals")
