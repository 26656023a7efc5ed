"""Which lines count as recurring: small cases, and the SQL on the same rows."""

import duckdb

from kinetable.llm import line_dedup

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll ledge".split()


def kept(spark, texts):
    """{doc_id: kept text}, after a comparison with the SQL."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    con = duckdb.connect()
    con.register("docs", df.toPandas())
    dropped = con.execute(f"WITH {line_dedup.ORACLE_DROP} SELECT d, line_no FROM dropped").fetchall()
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in set(dropped)) for i, t in enumerate(texts)}
    assert out == cut
    return out


def own(i):
    return f"{WORDS[i]} {WORDS[i + 1]} own {WORDS[i + 2]} body {WORDS[i + 3]}"


def test_variable_fourth_and_fifth_token(spark):
    texts = [f"{own(i)}\nThis page was {WORDS[i]} {WORDS[i + 5]} to you by the long standing company" for i in range(5)]
    out = kept(spark, texts)
    assert ["This page" in out[i] for i in range(5)] == [True, False, False, False, False]
    assert all(own(i) in out[i] for i in range(5))


def test_tabs_and_carriage_returns_part_tokens(spark):
    texts = [f"{own(i)}\nName\tStreet\tTown\tCountry\tTelephone" + "\r" * (i % 2) for i in range(4)]
    out = kept(spark, texts)
    assert ["Street" in out[i] for i in range(4)] == [True, False, False, False]


def test_two_documents_make_an_exact_line_recur(spark):
    passage = " ".join(WORDS * 5)
    texts = [f"{own(0)}\n{passage}\nIn 1999 the sum rose by 7 percent", f"{own(3)}\n{passage}\nIn 2004 the sum rose by 9 percent"]
    out = kept(spark, texts)
    assert passage in out[0] and passage not in out[1]
    assert "1999" in out[0] and "2004" in out[1]  # alike only under the mask: a third document is needed


def test_of_exact_copies_of_a_template_one_line_stays(spark):
    row = "Printed on page {} of the annual report"
    texts = [f"{own(i)}\n{row.format(n)}\n{row.format(n)}" for i, n in enumerate((5, 4, 5, 4))]
    out = kept(spark, texts)
    assert [out[i].count("Printed") for i in range(4)] == [1, 0, 0, 0]


def test_short_and_unspaced_lines(spark):
    lines = ["All rights reserved.", "版权所有，未经许可不得转载。", "สงวนลิขสิทธิ์ตามกฎหมาย", "Read more", "年", "Of."]
    texts = ["\n".join([own(i), *lines, "", " \t", f"Page {i}", f"Own{'abc'[i]} two"]) for i in range(3)]
    out = kept(spark, texts)
    assert all(x in out[0] for x in lines)
    # lines of one document stay, "Page 1" and "Page 2" are the template "Page <*>"
    assert "Page 0" in out[0]
    assert [out[i] for i in (1, 2)] == [f"{own(i)}\n\n \t\nOwn{'abc'[i]} two" for i in (1, 2)]


def test_short_templates_need_a_field_and_a_constant(spark):
    texts = [f"{own(i)}\nPage {i}\n{i}\n{i} {i + 1}\nSeite {i} von\n第{i}頁\n{'Chapter ' + str(i) if i < 2 else 'none here'}" for i in range(4)]
    out = kept(spark, texts)
    assert out[0] == texts[0]
    for i in (1, 2, 3):
        assert "Page" not in out[i] and "Seite" not in out[i]
        assert f"\n{i}\n{i} {i + 1}\n第{i}頁" in out[i]
    assert "Chapter 1" in out[1]  # two documents are too few for a template


def test_leaf_with_two_layouts(spark):
    """No token of the later places has a majority: lines of either layout go by their own template only."""
    texts = [f"{own(i)}\nSent by the {'office of trade' if i % 2 else 'board for roads'} in year {i}" for i in range(8)]
    out = kept(spark, texts)
    assert ["Sent by" in out[i] for i in range(8)] == [True, True] + [False] * 6


def test_document_of_very_many_lines(spark):
    import time

    many = "\n".join(f"only here {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} x" if i % 2 else f"again {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(100_000))
    df = spark.createDataFrame([(0, "\n".join(x for x in many.split("\n") if x.startswith("again"))), (1, many)], "doc_id long, text string")
    start = time.time()
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert out[1] == "\n".join(x for x in many.split("\n") if not x.startswith("again"))
    assert time.time() - start < 60


def test_hot_line_and_leaf_are_spread(spark):
    """Over one in HOT rows has one line, one leaf and one template: the same result as by SQL."""
    texts = [f"{own(i % 8)} {i}\nThe same line in every one of these texts\nRow of the long table number {i} of {i * 7}\n" + ("tail" if i % 2 else f"word{chr(97 + i % 26)}") for i in range(300)]
    out = kept(spark, texts)
    assert sum("The same line" in t for t in out.values()) == 1
