"""Content types, text extraction, number formats and colours on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from skychart.functions import markup, scaling, text


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("description", "declared", "expected"),
    [
        ("anything", "Text/Markdown; variant=GFM", "markdown"),
        ("anything", "text/x-rst", "rst"),
        ("# anything", "text/plain", "plain"),
        ("## Usage\n\nRead [more](https://example.org/a).", "", "plain"),
        ("## Usage\n\nRead [more](https://example.org/a) first.", None, "markdown"),
        (".. figure:: plan.svg\n\n.. warning::\n\n   Mind the step.", None, "rst"),
        ("tiny one", None, "plain"),
        ("", None, "plain"),
        (None, None, "plain"),
        ("# Überschrift der Seite\n", None, "markdown"),
        (" # ab  \n\x1c", None, "plain"),
    ],
)
def test_content_type(spark, description, declared, expected):
    df = spark.createDataFrame([(description, declared)], "d string, c string")
    assert df.select(markup.content_type(F.col("d"), F.col("c"))).first()[0] == expected


def test_scores(spark):
    rst = "T\n===\n\n.. a:: x\n\n:k: v\n:l: w `x`_"
    assert one(spark, rst, markup.rst_score) == 5 + 3 + 4 + 1
    assert one(spark, "a :k: b", markup.rst_score) == 0
    md = "# h\n![i](u) [l](u) **b** __c__ ```x```"
    assert one(spark, md, markup.markdown_score) == 3 * (1 + 2 + 1) + 4 + 2


@pytest.mark.parametrize(
    ("source", "kind", "expected"),
    [
        ("## Usage ##\n\nRun it **twice** a day.", "markdown", "Usage\nRun it\ntwice\na day."),
        ("# #\n\nA | b\n:-: | -\n*c* | ~~d~~", "markdown", "A\nb\nc\nd"),
        ("a <b c\n\n1 < 2 <https://example.org/x> [r][1]\n\n[1]: u", "markdown", "a <b c\n1 < 2\nhttps://example.org/x\nr"),
        ("a\nb  \nc", "markdown", "a\nb\nc"),
        ("x\n\n```py\n# no *markup*\n```\n\ny &amp; z", "markdown", "x\n# no *markup*\ny & z"),
        ("- [one](u)\n- ![no](i)\n- two", "markdown", "one\ntwo"),
        ("[![b](i)](u) after", "markdown", "after"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown", "a\nb\n1\n2"),
        ("Title\n-----\n\n> quote\n\n1. `x_y_z`", "markdown", "Title\nquote\nx_y_z"),
        ("snake_case_name and \\*star\\*", "markdown", "snake_case_name and *star*"),
        ("Nothing but a sentence.", "rst", "Nothing but a sentence."),
        (".. code:: py\n   :linenos:\n   :name: x\n\n   y = 1\n\n:py:meth:`run <a.run>` |b|_", "rst", "y = 1\nrun"),
        ("Title\n=====\n\n.. image:: a.png\n   :alt: x\n\nSee `docs <u>`_ now.", "rst", "Title\nSee\ndocs\nnow."),
        (".. note::\n\n   Mind.\n\n:author: me\n\n* ``a``\n* *b*", "rst", "Mind.\nauthor\nme\na\nb"),
        ("Code::\n\n  x = 1\n\n.. _t: http://u\n\nend", "rst", "Code:\nx = 1\nend"),
        ("One line, no markup.", "plain", "One line, no markup."),
        (" a \n\n <b> & c ", "plain", "a\n<b> & c"),
        ("<p>a<b>b</b>&eacute; &#233;&#x41;&lt;p&gt;</p><script>x</script><!-- n -->c", "html", "a\nb\né éA<p>\nc"),
        ("&nosuch; &hearts;&amp &#0;&#x110000;&#150;&#00065;&#xD800;&NotEqualTilde; &", "html", "&nosuch; ♥& \ufffd\ufffd–A\ufffd≂̸ &"),
        ("a<!-- b <p>c", "html", "a"),
        ("<p>a</p><script>if (1 < 2) b", "html", "a"),
        ("**bold *nested* text**", "markdown", "bold\nnested\ntext"),
        ("*a **b** c* ***d*** **e *f*** *g **h***", "markdown", "a\nb\nc\nd\ne\nf\ng\nh"),
        ("__a _b_ c__ and __init_file__ but not a_b_c or 2 * 3 * 4", "markdown", "a\nb\nc\nand\ninit_file\nbut not a_b_c or 2 * 3 * 4"),
        ("~~a *b* c~~ and *two\nlines*", "markdown", "a\nb\nc\nand\ntwo\nlines"),
        ("a **b\n\nc** d", "markdown", "a **b\nc** d"),
        ("[wiki](http://x.org/a_(b)) and [a [b] c](u(v(w))) end", "markdown", "wiki\nand\na [b] c\nend"),
        ("``a `b` c`` and `*d* &amp; \\*` and ` e", "markdown", "a `b` c\nand\n*d* &amp; \\*\nand ` e"),
        ("**see `x*y` [z](u)** <!-- `gone` --> `w`", "markdown", "see\nx*y\nz\nw"),
        ("[a][One] [b][] [c] [d][none] [e]\n\n[one]: u\n[B]: v\n[c]: <w>\n", "markdown", "a\nb\nc\n[d][none] [e]"),
        ('x <a title="p > q" href=\'r\'>link</a> y', "markdown", "x\nlink\ny"),
        ('<p>x <a title="p > q" href=\'r > s\'>link</a> y<br/>z<a href="b>c', "html", "x\nlink\ny\nz\nc"),
        ("<p don't>a</p> = <b c=\"d\">e</b>", "html", "a\n=\ne"),
        ("a\n\n.. a comment\n   more comment\n\n   still\n\nb", "rst", "a\nb"),
        ("..\n   hidden\n\nshown\n\n..\n\n   quoted", "rst", "shown\nquoted"),
        (".. |ver| replace:: 1.0\n.. |pic| image:: a.png\n\nVersion |Ver| and |pic| end |x", "rst", "Version 1.0 and\nend |x"),
        ("+---+---+\n| a | b |\n+---+---+\n\n| line", "rst", "a\nb\nline"),
        ("**a * b** and *c*", "rst", "a * b\nand\nc"),
        ("", "markdown", ""),
        ("   ", "rst", ""),
        (None, "plain", ""),
    ],
)
def test_extract(spark, source, kind, expected):
    assert one(spark, source, lambda v: text.extract_text(v, F.lit(kind))) == expected


def test_format_downloads(spark):
    cases = {
        0: "0", 999: "999", 1000: "1K", 1250: "1.3K", 12_345: "12.3K", 999_949: "999.9K", 999_950: "1M",
        1_200_000_000: "1.2B", 3_400_000: "3.4M", 10**15: "1000T", 10**16: "10,000T", None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "n bigint").select("n", scaling.format_downloads(F.col("n")))
    assert {r[0]: r[1] for r in rows.collect()} == cases


def test_cluster_color(spark):
    assert one(spark, -1, scaling.cluster_color, "int") == "#808080"
    assert one(spark, 0, scaling.cluster_color, "int") == "#d92626"
    assert one(spark, 1, scaling.cluster_color, "int") == "#26d95a"


def test_sizes(spark):
    df = spark.createDataFrame([(0,), (9,), (99,), (None,)], "d bigint")
    sizes = [r[0] for r in df.select(scaling.log_size(F.col("d"), F.lit(0), F.lit(99), 16, 128)).collect()]
    assert sizes == [16.0, 72.0, 128.0, None]
    equal = spark.createDataFrame([(5,)], "d bigint")
    assert equal.select(scaling.log_size(F.col("d"), F.lit(5), F.lit(5), 16, 128)).first()[0] == 16.0
    shown = spark.createDataFrame([(20.0, True), (0.0, True), (None, True), (20.0, False)], "s double, on boolean")
    got = [r[0] for r in shown.select(scaling.visible_size(F.col("s"), F.col("on"))).collect()]
    assert got == [20.0, 16.0, 16.0, 0.0]


LONG = 1 << 20
LINES = {
    "stars": "* ", "quotes": "> ", "bars": "|--", "rules": "_ ", "comments": "<!-- ", "scripts": "<script ", "links": "<a ",
    "images": "![", "brackets": "[", "open links": "[a](", "spaces": " ", "hashes": "# ", "ticks": "` ", "roles": ":a", "cells": "+-|",
    "nested": "*a ", "closing": "a* ", "pairs": "*a* ", "fences of one": "`a", "two ticks": "``a` ", "parens": "[a](b(c(", "values": '<a b="',
    "lookups": "[a][b] ", "bars": "|a| ", "dots": ".. a ", "references": "&#1", "names": "&a", "under": "**a_ ",
}


@pytest.mark.parametrize("kind", ["markdown", "rst", "html"])
def test_long_lines_are_safe(spark, kind):
    """Lines of a megabyte of each construct: no stack, and time linear in the text."""
    rows = [(name, "x " + unit * (LONG // len(unit)) + " y") for name, unit in LINES.items()]
    rows += [("start " + name, unit * (LONG // len(unit))) for name, unit in LINES.items()]
    rows.append(("options", ".. note::\n" + "   :a: b\n" * 100_000 + "\nend"))
    df = spark.createDataFrame(rows, "name string, v string").repartition(8)
    got = {r["name"]: r["n"] for r in df.select("name", F.length(text.extract_text(F.col("v"), F.lit(kind))).alias("n")).collect()}
    assert got.keys() == dict(rows).keys()
    if kind == "rst":
        assert got["options"] == len("end")
