from scriptorium.operators import audit, issues


def test_issue_rows(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    parts = [
        issues.orphan_media(make([(1, "b.png"), (1, "a.png")], "ms_id int, filename string")),
        issues.missing_captions(make([(1, "fig1", None), (1, "fig2", "Figure 2")], "ms_id int, float_id string, caption string")),
        issues.floating_images(make([(1, "fig1", True), (1, "fig2", False)], "ms_id int, fig_id string, floating boolean")),
        issues.estimated_positions(make([(1, "fig1", "neighbour"), (1, "fig2", "estimated"), (1, "fig3", "caption")], "ms_id int, fig_id string, method string")),
        issues.layout_tables(make([(1, "t1", 0), (1, "t1", 1)], "ms_id int, tab_id string, row int"), make([(1, "t2"), (1, "t3")], "ms_id int, tab_id string")),
        issues.number_mismatches(make([(1, 2, "3", 2)], "ms_id int, ord int, number_raw string, number int")),
        issues.headings(make([(2, 1)], "ms_id int, ord int"), make([(1, True), (1, False)], "ms_id int, by_model boolean"), make([(1, 0, True), (1, 1, False)], "ms_id int, sec_ord int, unwrapped boolean")),
        issues.roles(make([(1, 0, 1, "unknown", "default", "Odd"), (1, 1, 1, "methods", "model", "M")], "ms_id int, sec_ord int, level int, role string, role_method string, title_raw string")),
        issues.lost_text(make([(1, i, f"lost words {i}") for i in range(14)], "ms_id int, idx int, text string")),
    ]
    found = issues.numbered(*parts).collect()
    counts = {}
    for r in found:
        counts[r.code] = counts.get(r.code, 0) + 1
    assert counts == {
        "orphan_media": 1, "missing_caption": 1, "floating_image": 1, "figure_anchored_by_neighbour": 1, "figure_position_estimated": 1, "equation_table": 1, "layout_table_dropped": 1, "eqnum_mismatch": 1,
        "boilerplate_heading_demoted": 1, "implicit_headings": 1, "title_wrapper_unwrapped": 1, "unclassified_sections": 1, "role_model_used": 1, "text_lost_by_reader": 1, "recovered_paragraph": 12,
    }
    messages = {r.code: r.message for r in found}
    assert messages["orphan_media"].startswith("2 ") and messages["orphan_media"].endswith("a.png, b.png") and "42 words" in messages["text_lost_by_reader"]
    assert sorted(r.seq for r in found if r.ms_id == 1) == list(range(1, len(found)))
    dropped = issues.numbered(*parts).where("code = 'layout_table_dropped'")
    assert audit.accounted(spark.createDataFrame([(1, "t")], "ms_id int, tab_id string"), dropped).first().n == 3
