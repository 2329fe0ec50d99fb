"""Licence digests: equivalent forms, whole texts only, odd rows, and the query against SQL."""

from oracle import compare, database

from tickloom.llm import licenses
from tickloom.llm.queries import QUERIES, SQL


def test_query(spark, sf_dir):
    assert compare(spark, database(sf_dir), sf_dir, "op2_licenses", QUERIES["op2_licenses"], SQL["op2_licenses"]) > 0


def test_forms_and_odd_rows(spark):
    mit, isc = licenses.LICENSES["MIT"], licenses.LICENSES["ISC"]
    other = mit.replace("<year> <copyright holders>", "1999-2004 Some Body\n# Copyright 2005 Someone Else\nAll rights reserved.")
    rows = [
        (1, mit, "MIT"), (2, other.upper(), "MIT"), (3, " ".join(mit.split("\n")[:1] + mit.split("\n")[2:]), "MIT"),
        (4, mit.replace("License", "Licence").replace("sublicense", "sub-licence"), "MIT"), (5, mit + "\nAnd more.", None),
        (6, isc, "ISC"), (7, None, None), (8, "", None), (None, "*** released under the MIT licence ***", "MIT-notice"),
        (9, "word " * 200_000, None), (6, isc, "ISC"), (10, "licence licence licence", None), (11, "© 2020\n", None),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, license_id string, digest int")
    got = licenses.scan(docs, licenses.known(spark, licenses.LICENSES)).collect()
    assert sorted((r.doc_id or 0, r.license_id or "") for r in got) == sorted((i or 0, w or "") for i, _, w in rows)
    by = {r.doc_id: r for r in got}
    assert (by[7].digest, by[7].n_words) == (None, None)
    assert by[8].n_words == by[11].n_words == 0 and by[8].digest == by[11].digest
    assert by[9].n_words == 200_000 and by[10].n_words == 3
    assert licenses.scan(docs.limit(0), licenses.known(spark, licenses.LICENSES)).count() == 0
    nothing = licenses.known(spark, licenses.LICENSES).limit(0)
    assert {r.license_id for r in licenses.scan(docs, nothing).collect()} == {None}


def test_copyright_lines(spark):
    every = licenses.LICENSES | licenses.NOTICES
    heads = [
        "Copyright (c) Microsoft Corporation.", "Copyright (c) Jane Doe 2019", "Copyright Jane Doe 2019", "Copyright (c), 2019, X", "Copyright (c) {year}",
        "Copyright \u00a9 Acme Inc.", "\u00a9 Acme Inc.", "(c) Acme Inc.", "# Copyright: The Regents", " * Copyright by Jane Doe", "Portions copyright Jane Doe",
    ]
    rows = []
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        lines = every[name].split("\n")
        at = next(i for i, line in enumerate(lines) if line.startswith("Copyright (c) <year>"))
        rows += [("\n".join([*lines[:at], head, *lines[at + 1:]]), name) for head in heads]
        one_word_a_line = "\n".join(" ".join(lines[at + 1:]).replace("opyright ", "opyright \n# ").split(" "))
        rows.append(("\n".join(lines[:at]) + "\n" + one_word_a_line, name))
    rows += [(every[name], name) for name in every]
    bare = every["Zlib"].split("\n", 1)[1]
    items = "(a) one thing\n(b) another\n"
    rows += [(bare + "\nCopyright notices stay", None), (bare + "\nThe copyright", None), (bare + "\nCopyrights Jane Doe", None)]
    rows += [(items + "(c) a third", "three"), (items + "(c) no third", None), (items + "(c) 2019 Jane Doe\n(c) a third", "three")]
    known = licenses.known(spark, every | {"three": items + "(c) a third"})
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, known).collect()}
    assert [(rows[i][0], got[i]) for i in range(len(rows)) if got[i] != rows[i][1]] == []
