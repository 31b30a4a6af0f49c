"""Licence matches and inheritance against a plain version."""

import math
import random
import re

from pyspark.sql import types as T

from shopsignals.llm import license_scan as L

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "path", "text", "score", "license", "uid")])


def brute(rows):
    split = lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x]
    df = {v: sum(v in split(t or "") for _, _, t in rows) for v in {x for _, body in L.TEMPLATES for x in split(body)}}
    idf = lambda v: math.log((1 + len(rows)) / (1 + df.get(v, 0))) + 1

    def vec(t):
        c = {}
        for x in split(t):
            c[x] = c.get(x, 0) + 1
        return {x: n * idf(x) for x, n in c.items()}

    def match(t):
        v = vec(t)
        n = math.sqrt(sum(x * x for x in v.values()))
        if not n:
            return None
        s = {}
        for name, body in L.TEMPLATES:
            u = vec(body)
            s[name] = max(s.get(name, 0), round(sum(v.get(k, 0) * x for k, x in u.items()) / n / math.sqrt(sum(x * x for x in u.values())), 6))
        (a, b), (c, _) = sorted((-x, name) for name, x in s.items())[:2]
        return (a, b) if -a >= L.MATCH and c - a >= L.MARGIN else None
    own = []
    for k, p, t in rows:
        w = match(t) if t else None
        h = min((m for s in re.sub(L.SENTENCE_END, "\\1\n", t or "").split("\n") if (m := match(s))), default=None)
        hs, ws = -h[0] if h else 0, -w[0] if w else 0
        name = w[1] if ws >= L.WHOLE else h[1] if h else w[1] if w else None
        is_file = ws >= L.WHOLE or (h is not None and bool(re.search(L.FILE_NAME, p or "")))
        own.append((k, p, None if p is None else re.sub("/?[^/]*$", "", p, count=1), round(max(hs, ws), 4), name, is_file, max(hs, ws)))
    dirs = {}
    for k, p, d, s, name, is_file, exact in own:
        if is_file and d is not None:
            dirs[d] = min(dirs.get(d, (9, "", "")), (-exact, name, p))
    out = []
    for k, p, d, s, name, is_file, _ in own:
        at = None
        if name is None and d is not None:
            up = ["/".join(d.split("/")[:i]) for i in range(len(d.split("/")), 0, -1)] + [""] if d else [""]
            at = next((u for u in up if u in dirs), None)
        out.append((k, p, name or (dirs[at][1] if at is not None else None),
                    "file" if is_file else "header" if name else "inherited" if at is not None else "none", s, at))
    return sorted(out, key=str)


def test_matches_plain_version(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("1", "a/LICENSE", mit + "\nsome more text of a file about other things entirely"), ("2", "a/x.py", "code here"), ("3", "a/b/c/y.py", "more code"),
            ("4", "a/b/COPYING.txt", gpl), ("5", "a/b/z.py", "# " + mit + "\nimport z"), ("6", "top.py", "nothing"), ("7", "d/e.py", None),
            ("8", "d/notes", "This is licensed to nobody. The licence of words, copyright of thoughts."), ("9", None, mit), ("10", None, "plain"),
            ("11", "a/b", "sibling of folder b"), ("12", "ab/q.py", "not below a"), ("13", "a/b/c/y.py", "more code"), ("14", "f/LICENSE", "no known words"),
            ("15", "g/one", "Licensed under CC BY-NC 4.0."), ("16", "g/two", "Licensed under CC BY 4.0. "), ("17", "g/h/three", ""),
            ("18", "w", "word " * 3000 + ". Licensed under the Apache License, Version 2.0. " + "word " * 3000), ("19", "/abs/LICENSE", mit), ("20", "/abs/f", "x")]
    df = spark.createDataFrame([r + ("s", "l", "u") for r in rows], SCHEMA).repartition(3)
    got = L.scan(df, "id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    by = {r["id"]: r for r in got}
    assert by["3"]["license"] == "GPL-3.0" and by["2"]["license"] == "MIT" and by["5"]["origin"] == "header" and by["18"]["license"] == "Apache-2.0"


def test_root_licence_and_empty_table(spark):
    rows = [("1", "LICENSE", "Released under the MIT License."), ("2", "x/y/z", "text")]
    df = spark.createDataFrame([r + ("s", "l", "u") for r in rows], SCHEMA)
    assert {r["id"]: (r["license"], r["license_folder"]) for r in L.scan(df, "id").collect()} == {"1": ("MIT", None), "2": ("MIT", "")}
    assert L.scan(df.limit(0), "id").collect() == []


def test_documents_with_nulls(docs):
    out = L.scan_documents(docs([(1, "Released under the MIT License.", "en", "s", 0), (2, "x", "en", "s", 0), (3, None, None, None, None), (None, None, None, None, None)], extra=True)).collect()
    assert {r["doc_id"]: r["origin"] for r in out} == {1: "file", 2: "inherited", 3: "none", None: "none"}


def test_whole_texts_are_named_rightly(spark):
    """Every template as a file of its own among other files, with some words more."""
    rnd = random.Random(1)
    prose = [" ".join(rnd.choice(["the", "of", "river", "stone", "a", "light", "over", "in", "house", "and"]) for _ in range(60)) for _ in range(80)]
    rows = [(f"{k:03d}", f"p{k:03d}/LICENSE", f"Copyright (c) 2024 Someone\n\n{body}\n") for k, (_, body) in enumerate(L.TEMPLATES)]
    rows += [(f"x{k}", f"p{k:03d}/src/a.py", "print(1)") for k in range(len(L.TEMPLATES))]
    rows += [(f"y{k}", f"q/{k}.txt", t) for k, t in enumerate(prose)]
    rows += [("z1", "r/1", "SPDX-License-Identifier: WTFPL"), ("z2", "r/2", "You need a license to fish in this river."), ("z3", "r/3", "Released under the Foobar License.")]
    df = spark.createDataFrame([r + ("s", "l", "u") for r in rows], SCHEMA).repartition(3)
    by = {r["id"]: r for r in L.scan(df, "id").collect()}
    for k, (name, _) in enumerate(L.TEMPLATES):
        assert (by[f"{k:03d}"]["license"], by[f"x{k}"]["license"], by[f"x{k}"]["origin"]) == (name, name, "inherited"), (k, name, by[f"{k:03d}"])
    assert all(by[k]["license"] is None for k in [f"y{k}" for k in range(80)] + ["z1", "z2", "z3"])


def test_texts_without_key_terms_match_nothing(spark):
    """What is left out before scoring scores below the match by the plain version."""
    words = sorted({t for _, body in L.TEMPLATES for t in re.split("[^a-z0-9]+", body.lower()) if t})
    rnd = random.Random(3)
    rows = [(str(k), f"d{k}/f", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for k in range(150)]
    rows += [(str(200 + k), f"e{k}/f", " ".join(body.split()[:n])) for k, (_, body) in enumerate(L.TEMPLATES) for n in [rnd.randint(1, len(body.split()))]]
    df = spark.createDataFrame([r + ("s", "l", "u") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, L.scan(df, "id").collect()), key=str) == brute(rows)
