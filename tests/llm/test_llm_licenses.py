"""Licences at other line widths, with titles, and the longer texts."""

import hashlib
import random
import textwrap
from pathlib import Path

import regex

from abacora.llm import license_scan


def ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in license_scan.scan(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_line_width_does_not_matter(spark):
    bodies = [(i, b) for i, b in license_scan.KNOWN[:5]]
    texts = [("Copyright (c) 2020 A. Smith, Inc.\n\n" + textwrap.fill(b, width), i) for i, b in bodies for width in range(40, 100, 6)]
    texts += [("Copyright (c) 2020 A. Smith. " + b, i) for i, b in bodies] + [("Copyright 2019 A. All rights reserved.\n" + b, i) for i, b in bodies]
    texts += [(textwrap.fill("Copyright (c) 2020 A. " + b, 60), i) for i, b in bodies]
    assert ids(spark, [t for t, _ in texts]) == [i for _, i in texts]


def test_titles_and_other_bodies(spark):
    texts = [(f"{title}\n\nCopyright (c) 2020 A\n\n{body}", i) for i, body in license_scan.BODIES for title in license_scan.TITLES[i]] + [(b, i) for i, b in license_scan.BODIES]
    texts += [(Path(f"/usr/share/common-licenses/{f}").read_text(), i) for f, i in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")) if Path(f"/usr/share/common-licenses/{f}").exists()]
    assert ids(spark, [t for t, _ in texts] + ["MIT License", texts[0][0] + " more"]) == [i for _, i in texts] + [None, None]


def plain_canonical(text):
    out = regex.sub(license_scan.NOTICE, " ", text or "").lower()
    for pattern, one in license_scan.SPELLINGS:
        out = regex.sub(pattern, one, out)
    return regex.sub(license_scan.NOT_WORD, " ", out).strip()


def test_equals_a_plain_lookup_over_documents_with_planted_licences(spark):
    rng = random.Random(3)
    words = "software grants license copyright 2020 (c) © Rights holder sub-license Licence THE. all rights reserved\n per cent".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(120)]
    spelled = lambda b: b.replace("license", "licence").replace("sublicense", "sub-license").upper() if rng.random() < 0.5 else b
    texts += [rng.choice(["", "Copyright (c) 2020 A. ", "# Copyright 2019-2021 B, Inc.\n", "© C\n\n", "All rights reserved\n"]) + spelled(body) for _, body in license_scan.TEXTS for _ in range(2)]
    texts += [None, "", " \n", "© 2020", "word " * 30000, license_scan.KNOWN[0][1] + " and more", license_scan.KNOWN[0][1]]
    known = {}
    for i, body in license_scan.TEXTS:
        digest = hashlib.sha256(plain_canonical(body).encode()).hexdigest()
        known[digest] = min(i, known.get(digest, i))
    known |= {d: i for i, d in license_scan.DIGESTS}
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license_id string").repartition(4)
    got = {r["doc_id"]: (r["license_id"], r["canonical_chars"], r["canonical_sha256"]) for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        c = plain_canonical(t)
        digest = hashlib.sha256(c.encode()).hexdigest()
        assert got[i] == (known.get(digest) if c else None, len(c), digest), t
    assert sum(x[0] is not None for x in got.values()) >= 2 * len(license_scan.TEXTS)


def test_one_digest_with_two_names_takes_the_first(spark):
    known = (("Z-1", "Some terms."), ("A-1", "some TERMS"), ("M-1", "some, terms"))
    df = spark.createDataFrame([(1, "SOME terms!"), (1, "some terms"), (None, "some terms"), (2, "other")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["license_id"]) for r in license_scan.scan(df, known).collect()), key=str) == sorted([(1, "A-1"), (1, "A-1"), (None, "A-1"), (2, None)], key=str)
