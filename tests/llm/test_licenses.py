import math
import re
from pathlib import Path

from tarmac.llm.licenses import LICENSE_FILE, TEMPLATES, Weights, full_texts, op5_licenses, scanned, terms


def brute(rows, threshold=0.6):
    """rows: (key, path, text) -> (key, path, license, similarity, origin, inherited_from)."""
    names = sorted(set().union(*(terms(t) for _, t in TEMPLATES)))
    w = Weights.of(TEMPLATES, {t: sum(t in terms(x or "") for _, _, x in rows) for t in names}, len(rows))
    own = {}
    for _, path, text in rows:
        if path is None:
            continue
        text = text or ""
        parts = re.split(r"[\n\r]+|(?<=[.!?])[ \t]+(?=[A-Z])", text)
        if re.match(LICENSE_FILE, path.rpartition("/")[2]):
            parts.append(text)
        for p in parts:
            vector = {t: n * w.idf.get(t, w.other) for t, n in terms(p).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            for (name, _), template in zip(TEMPLATES, w.vectors):
                s = round(sum(v * template.get(t, 0) for t, v in vector.items()) / norm, 6) if norm else 0
                if s >= threshold and (path not in own or (-s, name) < (-own[path][1], own[path][0])):
                    own[path] = (name, s)
    held = {}
    for path, (name, s) in own.items():
        folder, _, base = path.rpartition("/")
        if re.match(LICENSE_FILE, base) and (folder not in held or (-s, path) < held[folder][0]):
            held[folder] = ((-s, path), name, s)
    out = []
    for key, path, _ in rows:
        if path in own:
            out.append((key, path, *own[path], "stated", None))
            continue
        folder = path.rpartition("/")[0] if path is not None else None
        while folder is not None and folder not in held:
            folder = None if folder == "" else folder.rpartition("/")[0]
        out.append((key, path, *held[folder][1:], "inherited", folder) if folder is not None else (key, path, None, None, None, None))
    return out


def same(got, want):
    say = lambda r: tuple(round(x, 5) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(say, got))) == sorted(map(str, map(say, want)))


ROWS = [
    (1, "a/b/LICENSE", "Released under the MIT License."),
    (2, "a/b/c/x.py", "nothing here"),
    (3, "a/LICENSE.txt", "Copyright 2020.\nLicensed under the Apache License, Version 2.0.\nmore"),
    (4, "a/y.py", None),
    (5, "a/b/z.py", "# Licensed under CC BY-NC 4.0. Have fun with it"),
    (6, "q/y.py", ""),
    (7, "top.py", "the license of the work under the version"),
    (8, None, "Released under the MIT License."),
    (9, "a/b/c/d/w.py", "words " * 50_000 + "\nReleased under the MIT license"),
    (10, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (10, "a/b/COPYING", "again, nothing"),
    (None, "a/b/c/x.py", "nothing here"),
]


def test_defined_cases(spark):
    files = spark.createDataFrame(ROWS, "doc_id long, path string, text string").selectExpr("*", "1 AS license", "'x' AS term")
    got = scanned(files).collect()
    same(got, brute(ROWS))
    by = {r.path: r for r in got}
    assert by["a/b/c/x.py"].inherited_from == "a/b" and by["a/y.py"].license == "Apache-2.0" and by["q/y.py"].license is None
    assert by["a/b/c/d/w.py"].license == "MIT" and by["top.py"].license is None
    assert scanned(files.limit(0)).count() == 0
    root = [*ROWS, (11, "LICENSE", "Released under the MIT License.")]
    got = scanned(spark.createDataFrame(root, "doc_id long, path string, text string")).collect()
    same(got, brute(root))
    assert {r.path: r.license for r in got}["q/y.py"] == "MIT"


def test_needed_terms_are_needed():
    w = Weights.of(TEMPLATES, {"the": 900, "is": 800, "of": 900, "to": 900, "license": 5}, 1000)
    needed = set(w.needed(0.6))
    for v in w.vectors:
        assert math.sqrt(sum(x * x for t, x in v.items() if t not in needed)) < 0.6


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(d.doc_id, "/".join([d.source, d.lang, f"LICENSE.{d.doc_id}" if len(d.text) <= 400 else f"{d.doc_id}.txt"]), d.text) for d in docs]
    got = op5_licenses(spark, sf).collect()
    same(got, brute(rows))
    stated = {r.doc_id: r.license for r in got if r.origin == "stated"}
    for d in docs:
        for name, line in (("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.")):
            if line in d.text:
                assert stated[d.doc_id] == name


def test_whole_license_files(spark):
    texts = dict(full_texts()[0])
    head = "Some Project 2.1\n\nCopyright (c) 2019-2024 Ada Example <ada@example.org>\nCopyright 2021, The Example Authors. All rights reserved.\n\n"
    rows = []
    for k, (name, text) in enumerate(texts.items()):
        rows += [(10 * k, f"a/{name}/LICENSE", head + " ".join(text.split())), (10 * k + 1, f"a/{name}/src/x.py", "nothing here"), (10 * k + 2, f"a/{name}/NOTICE", "GNU GENERAL PUBLIC LICENSE")]
    rows += [(9001, "c/LICENSE", "words of no licence " * 300), (9002, "d/LICENSE", None)]
    # a real file of another source, where this machine has it
    other = Path("/usr/share/common-licenses/BSD")
    if other.exists():
        rows.append((9003, "e/LICENSE", other.read_text()))
    got = {r.doc_id: r for r in scanned(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, name in enumerate(texts):
        assert (got[10 * k].license, got[10 * k].origin) == (name, "stated") and got[10 * k].similarity >= 0.9
        assert (got[10 * k + 1].license, got[10 * k + 1].inherited_from) == (name, f"a/{name}")
    assert got[9001].license is None and got[9002].license is None
    assert 9003 not in got or got[9003].license == "BSD-3-Clause"
