"""Lines above the limit are removed from the texts; the query does not carry texts through its joins."""

from ledgerlint.llm import line_rules


def test_frequent_lines_are_removed_from_the_text(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(55))
    rows = [(i, "h", f"{own(chr(97 + i))}\n\n  The FOOTER  of 2019\nlast {chr(97 + i)}") for i in range(12)]
    rows += [(20, "other", "the footer of 2019\nmore"), (21, "h", None), (22, "h", "The footer of 2024"), (23, "h", "")]
    out = {r.doc_id: r for r in line_rules.line_frequency_rules(
        spark.createDataFrame(rows, "doc_id long, source string, text string"), max_line_docs=10).collect()}
    for i in range(12):
        assert out[i].clean_text == f"{own(chr(97 + i))}\n\nlast {chr(97 + i)}" and out[i].text == rows[i][2]
        assert out[i].n_frequent_words == 4 == len(out[i].text.split()) - len(out[i].clean_text.split()) and out[i].kept
    assert (out[20].clean_text, out[21].clean_text, out[22].clean_text, out[23].clean_text) == (rows[12][2], None, "", "")


def test_query_does_not_carry_texts(spark):
    docs = spark.createDataFrame([(1, "h", "a b c")], "doc_id long, source string, text string")
    plan = line_rules.line_rules_digest(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "array_contains" not in plan
