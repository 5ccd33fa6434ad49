import os

import pytest

from millrace.operators import scan
from millrace.sources import corpus

#: A line that each built-in pattern finds, and one like it that it doesn't.
LINES = {
    "secrets-exposure": [("a.py", 'password = "abcdefghij0123456789"', 'password = "short"')],
    "graphql-injection": [("a.rs", 'format!("query {{ Job {x} }}")', 'println!("query {}")')],
    "secret-in-fallback": [("a.rs", 'env::var("DB_PASSWORD").unwrap_or_default()', 'env::var("HOME").unwrap_or_default()'), ("b.ts", "const k = process.env.MY_SECRET ?? 'fallback'", "const k = process.env.MY_SECRET")],
    "insecure-crypto": [("a.go", "h := sha1(data)", "h := sha256(data)")],
    "secret-in-log": [("a.rs", 'warn!("bad password {p}")', 'warn!("bad name {p}")'), ("b.js", "console.error('no token', t)", "console.table('token')")],
    "command-injection": [("a.rs", 'Command::new("bash").arg("-c")', 'Command::new("ls")'), ("b.rs", 'c.args(format!("{x}"))', "c.args(list)")],
    "webhook-handler": [("a.tsx", "function onWebHook() {}", "function onHook() {}")],
    "path-traversal": [("a.rs", "base.join(&request_name)", 'base.join("fixed")')],
    "missing-auth": [("a.rs", '.route( "/x", get(h))', ".route(x)"), ("b.rs", '#[post("/y")]', "#[test]")],
}


def test_every_pattern_finds_its_line():
    assert {m.slug for m in scan.MATCHERS} == set(LINES) and sum(len(m.patterns) for m in scan.MATCHERS) == sum(map(len, LINES.values()))
    for slug, cases in LINES.items():
        for path, yes, no in cases:
            assert [(s, n) for s, _, n, _ in scan.find(f"\n{yes}\n", path) if s == slug] == [(slug, 2)], yes
            assert not [s for s, *_ in scan.find(no, path) if s == slug], no


def test_texts_of_any_size(spark):
    long = "x = 1\n" * 400_000 + "h = md5(x)\n"
    df = spark.createDataFrame([("a.py", long, 1), ("b.py", None, 1), (None, "md5(", 1), ("c.py", "", 1)], "path string, content string, slug int")
    assert [(r.path, r.line) for r in scan.candidates(df).collect()] == [("a.py", 400_001)]
    assert not scan.candidates(df, most_bytes=1 << 20).collect() and not scan.payload(scan.candidates(df.limit(0)), 100).collect()


@pytest.mark.parametrize(
    ("lines", "path", "out"),
    [
        ("*.log", "a/b.log", True), ("/a.txt", "b/a.txt", False), ("/a.txt", "a.txt", True), ("build/", "x/build/y", True), ("build/", "x/build", False), ("a/**/z", "a/b/c/z", True),
        ("a/**/z", "a/z", True), ("*.log\n!keep.log", "keep.log", False), ("d/\n!d/keep", "d/keep", True), ("# c\n\n\\#x", "#x", True), ("f?o[0-9]", "fao7", True), ("f[!a]o", "fao", False), ("x/*", "x/y/z", True), ("*.a ", "q.a", True),
    ],
)
def test_ignore_rules(lines, path, out):
    assert corpus.ignored(path, corpus.rules_of("", lines)) is out


def test_files_of_a_folder(spark, tmp_path):
    files = {"a.rs": "fn a() {}", "sub/b.rs": "é", "sub/.gitignore": "*.tmp\n!good.tmp\n", "sub/x.tmp": "x", "sub/good.tmp": "g", ".gitignore": "out/\n", "out/c.rs": "c", ".hidden/d.rs": "d", "sub/.e": "e", "big.txt": "x" * 2000, "_init.rs": "i", "_gen/y.rs": "y"}
    for name, text in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "bin.rs").write_bytes(b"\xff\xfe\x00")
    got = {r.path: r.content for r in corpus.read(spark, str(tmp_path), 1000).collect()}
    assert got == {"a.rs": "fn a() {}", "sub/b.rs": "é", "sub/good.tmp": "g", "_init.rs": "i", "_gen/y.rs": "y"}
    assert "big.txt" in {r.path for r in corpus.read(spark, str(tmp_path), None).collect()}
