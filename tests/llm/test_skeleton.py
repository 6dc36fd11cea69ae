import unicodedata

from docloom.llm.skeleton import look_alike_groups, look_alike_pairs, plain_words, skeleton

KIND = "doc_id long, text string, shape string, stored int"


def test_what_looks_alike_has_one_skeleton():
    plain = "Le résumé final, page 27 - O.K."
    for other in ("Ｌｅ résumé ﬁnal, page ２７ - O.K.", unicodedata.normalize("NFD", plain), "Le ré​su­mé final, page 27 ‑ O.K.", "Lе résumé final, pagе 27 - О.К."):
        assert skeleton(other) == skeleton(plain), other


def test_what_the_eye_tells_apart_stays_apart():
    for a, b in (("resume", "résumé"), ("page 27", "page 28"), ("O", "0"), ("l", "1"), ("Abc", "abc"), ("a  b", "a b"), ("x2", "x²"), ("a\tb", "a b"), ("a\nb", "a b"), ("a–b", "a—b")):
        assert skeleton(a) != skeleton(b), (a, b)


def test_words_ignore_case_punctuation_and_look_alikes():
    assert plain_words("Тhe OFFICE-page: ２７!") == ["the", "office", "page", "27"]
    assert plain_words("ВАШ") == plain_words("ваш")
    assert plain_words(None) == plain_words("") == plain_words(" ­") == []


def test_pairs_against_brute_force(spark):
    rows = [(1, "abc", "x", 1), (2, "аbc", "x", 1), (3, "abc", "x", 1), (4, "a bc", "x", 1), (5, None, "x", 1), (6, "​", "x", 1), (7, "", "x", 1), (None, "abc", "x", 1), (8, "z" * 200_000, "x", 1), (9, "z" * 199_999 + "ｚ", "x", 1), (1, "abc", "x", 1)]
    texts = {i: t or "" for i, t, *_ in rows if i is not None}
    want = {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and skeleton(texts[a]) == skeleton(texts[b])}
    df = spark.createDataFrame(rows, KIND)
    assert {tuple(r) for r in look_alike_pairs(df).collect()} == want == {(1, 2), (2, 3), (5, 6), (6, 7), (8, 9)}
    groups = {r.doc_id: (r.group_id, r.variants) for r in look_alike_groups(df).collect()}
    assert groups[3] == (1, 2) and groups[7] == (5, 2) and groups[4] == (4, 1)


def test_empty_table(spark):
    assert look_alike_pairs(spark.createDataFrame([], KIND)).count() == 0
    assert look_alike_groups(spark.createDataFrame([], KIND)).count() == 0


def test_standard_look_alikes_of_other_scripts(spark):
    """A hundred letters that the Unicode table of confusables, and the eye, hold for a Latin one."""
    from docloom.llm.skeleton import prototypes

    table = prototypes(spark)
    pairs = {
        "Cyrillic": ("АВЕЅІЈКМНОРСТУХѴаеѕіјорсухѵһԁԛԝ", "ABESIJKMHOPCTYXVaesijopcyxvhdqw"),
        "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺαινορυϲϳ", "ABEZHIKMNOPTYXCMaivopucj"),
        "Armenian": ("ՍՏՕհոսօցզ", "USOhnuogq"),
        "Lisu": ("ꓐꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BDTGKJCZFMNLSRVHWXYAEIOU"),
        "Coptic": ("ⲞⲠ"[:1] + "ⲤⲦⲢⲔⲘⲚ", "OCTPKMN"),
        "styles": ("Ⅰⅼ𝐀𝒃𝔠𝕕𝖾𝗳ℓ", "IlAbcdefl"),
        "small": ("ᴏꜱᴄᴠᴡᴢ", "oscvwz"),
    }
    assert sum(len(a) for a, _ in pairs.values()) >= 100
    for name, (others, plain) in pairs.items():
        assert len(others) == len(plain), name
        for a, b in zip(others, plain, strict=True):
            assert skeleton(a, table) == b, (name, a, b)
    for a, b in (("resume", "résumé"), ("O", "0"), ("l", "1"), ("Abc", "abc"), ("x2", "x²"), ("aª", "aa"), ("ß", "B"), ("œ", "oe"), ("ç", "c")):
        assert skeleton(a, table) != skeleton(b, table), (a, b)


def test_operators_use_the_whole_table(spark):
    rows = [(1, "BOAT note", "x", 1), (2, "ꓐꓳꓮꓔ note", "x", 1), (3, "ⲂOAT note", "x", 1)]
    assert (1, 2) in {tuple(r) for r in look_alike_pairs(spark.createDataFrame(rows, KIND)).collect()}
