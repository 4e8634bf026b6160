"""D-02 item ranges on literal Markdown."""

from tessera.operators import report as RP


def test_item_ranges_count_per_required_section(spark):
    text = "\n".join([
        "## Resumo Executivo", "texto",
        "## Achados Principais", "- a", "- b", "* c", "- d", "- e",
        "## Riscos Identificados", "- so um",
        "## Outra", "- x", "- y", "- z",
        "## Achados Principais", "- f", "- g",
    ])
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    got = {r.section: (r.items, r.within_range)
           for r in RP.item_ranges(docs, "doc_id", "text").collect()}
    # a repeated heading adds to the same section; a missing one has 0 items
    assert got == {"Achados Principais": (7, False), "Riscos Identificados": (1, False),
                   "Recomendações": (0, False)}


def test_item_ranges_web_structure(spark):
    text = "## Próximos Passos\n- a\n- b\n- c\n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = RP.item_ranges(docs, "doc_id", "text", RP.WEB_ITEM_RANGES)
    got = {r.section: r.within_range for r in rows.collect()}
    assert got == {"Indicadores-Chave": False, "Achados Principais": False,
                   "Riscos Identificados": False, "Próximos Passos": True}


def test_misplaced_sections_are_the_fewest(spark):
    import itertools

    from tessera.operators import report as RP

    names = ("A", "B", "C", "D")
    cases = [c for n in range(5) for c in itertools.product("ABCDx", repeat=n)]
    df = spark.createDataFrame([(i, "\n".join(f"## {h}" for h in c)) for i, c in enumerate(cases)] + [(-1, None)],
                               "i int, text string")
    got = {r.i: r.misplaced for r in RP.misplaced_sections(df, "i", "text", names).collect()}
    assert got[-1] == []
    for i, case in enumerate(cases):
        own = [(at, h) for at, h in enumerate(case) if h in names]
        best = min((s for n in range(len(own) + 1) for s in itertools.combinations(own, n)
                    if all(a[1] < b[1] for a, b in zip(s, s[1:]))), key=lambda s: (-len(s), [at for at, _ in s]))
        assert got[i] == [h for at, h in own if (at, h) not in best], case


def test_derived_numbers_need_the_named_groups(spark):
    from tessera.operators import report as RP

    groups = spark.createDataFrame([("SP", 4000), ("RJ", 1330), ("MG", 1000), ("Rio Grande do Sul", 3670),
                                    (None, 0)], "g string, u bigint")
    text = ("SP, RJ e MG somam 63,3% do total. SP tem 3,01 vezes RJ e 4 vezes MG.\n"
            "RJ e MG somam 63,3%. Rio Grande do Sul tem 36,7 %! Nada tem 50%. Rio Grande tem 36,7%.")
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    got = [(r.sentence, r.pos, r.number_text, r.kind, r.named, r.grounded)
           for r in RP.derived_grounding(docs, "i", "t", groups, "g", "u").orderBy("sentence", "pos").collect()]
    assert got == [(0, 0, "63,3", "share", 3, True), (1, 0, "3,01", "ratio", 3, True), (1, 1, "4", "ratio", 3, True),
                   (2, 0, "63,3", "share", 2, False), (3, 0, "36,7", "share", 1, True), (4, 0, "50", "share", 0, False),
                   (5, 0, "36,7", "share", 0, False)]
