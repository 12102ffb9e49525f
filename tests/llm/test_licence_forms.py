"""Licence forms: other line widths and comment leaders match, altered clauses don't, and SQL agrees on odd line ends."""

import re
import textwrap

import duckdb
import pytest

from tests.harness import compare
from veil.llm import licences

STATED = re.compile(licences.COPYRIGHT)


def paragraphs(text):
    return re.split(r"\n[ \t]*\n", text)


def wrapped(text, width):
    """Paragraphs on lines of another width; copyright statements keep their lines."""
    out = []
    for p in paragraphs(text):
        lines, held = [], []
        for line in [*p.split("\n"), None]:
            if line is None or STATED.match(line):
                if held:
                    lines += textwrap.wrap(" ".join(x.strip() for x in held), width, break_long_words=False, break_on_hyphens=False)
                held = []
                if line is not None:
                    lines.append(line)
            else:
                held.append(line)
        out.append("\n".join(lines))
    return "\n\n".join(out)


def known_texts(spark):
    return [(r["licence"], r["text"]) for r in licences.full_texts(spark).collect()] + [(n, t) for n, ts in licences.KNOWN.items() for t in ts if len(t) > 400]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    return {r["doc_id"]: r["licence"] for r in licences.scanned(docs, licences.known_digests(spark)).collect()}


def test_other_widths_and_leaders_match(spark):
    names, texts = [], []
    for name, text in known_texts(spark):
        for width in range(50, 121, 7):
            names.append((name, width))
            texts.append(wrapped(text, width))
        for lead in ("    ", "# ", "// ", " * ", "; "):
            names.append((name, lead))
            texts.append("\n".join(lead + line for line in wrapped(text, 78).split("\n")))
        names.append((name, "stated"))
        texts.append(f"Copyright (c) 2021-2023 Some One\n# (C) 1999 Another\n// © 2001, 2002 A. Third\n{text}\n\nCopyright [yyyy] [name]")
    got = found(spark, texts)
    same = {}
    for name, text in known_texts(spark):
        same.setdefault(name, set()).add(name)
    missed = [names[i] for i, licence in got.items() if licence is None]
    assert not missed, missed[:20]
    assert all(got[i] == name for i, (name, _) in enumerate(names))


def test_altered_clauses_miss(spark):
    texts = []
    for _, text in known_texts(spark):
        parts = paragraphs(text)
        for k, p in enumerate(parts):
            words = [w for w in re.finditer(r"[A-Za-z]{4,}", p) if not any(m.start() <= w.start() < m.end() for m in re.finditer(licences.COPYRIGHT, p))]
            if words:
                w = words[len(words) // 2]
                texts.append("\n\n".join([*parts[:k], p[: w.start()] + "altered" + p[w.end() :], *parts[k + 1 :]]))
    assert len(texts) > 500 and not [x for x in found(spark, texts).values() if x]


@pytest.mark.parametrize("line", ["(c) You must retain, in the Source form", "copyright law applies", "Copyright holders may", "  (c) 12 months", "copyrighted 2001", "The copyright 2001"])
def test_lines_that_are_text(line):
    assert not STATED.search(line)


@pytest.mark.parametrize("line", ["Copyright (c) Some One", "copyright 2001 X", "/* Copyright: © A", "  ## (C) 1999-2001", "Copyright <YEAR> <HOLDER>", "COPYRIGHT [yyyy] [name]", "© 2020 X"])
def test_lines_that_state_a_copyright(line):
    assert STATED.search(line) and STATED.sub(r"\1", f"a\n{line}\n{line}\nb") == "a\n\n\nb"


def test_sql_agrees_on_odd_line_ends(spark):
    mit = licences.KNOWN["MIT"][1]
    rows = [mit.replace("\n", end) for end in ("\r\n", "\r", " ", "\n\n", "\x0b", "\x85")]
    rows += [f"Copyright 2020 A{end}{mit}" for end in ("\n", "\r", "\r\n", " ", "\x85")] + [f"{end}Copyright 2020 A\n{mit}" for end in ("\n", "\r", " ", "x")]
    rows += ["(c) 2001\n(c) 2002\n" + mit, None, "", "Copyright (c) alone", "\n", "Released under the MIT License.\rReleased under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert compare(licences.scanned(docs, licences.known_digests(spark)), con, licences.oracle_sql()) == len(rows)
