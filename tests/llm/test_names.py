import pytest

from assetlake.llm import names

SAME = [
    ("Alexander Fokirefura", "Alex Fokirefura"), ("Alexander Fokirefura", "Fokirefura, A."), ("Alexander Fokirefura", "alexander  fokirefura "), ("Alexander Fokirefura", "Alexander W. Fokirefura"),
    ("Alexander Fokirefura", "Alexandre Fokirefúra"), ("Alexander Fokirefura", "Alexander Fokierfura"), ("The Vopivifoda Quartet", "Vopivifoda 4tet"), ("The Vopivifoda Quartet", "Vopivifoda Quartet, The"),
    ("Saint Pafopajexu Choir", "Choir of St. Pafopajexu"), ("Ciwagudubu and the Lanterns", "Ciwagudubu & Lanterns"), ("Bavilagaro Brothers Band", "Bavilagaro Bros"), ("Liz Huxutiyofu", "Beth Huxutiyofu"),
    ("The Guputipoco Sessions, Vol. II", "Guputipoco Sess. v2"), ("Letters to Darucowica and Other Stories", "Darucowica, Letters to"), ("Songs for Mehonujeba", "Songs 4 Mehonujeba"), ("Nights in Gifexohume", "Nites in Gifexohume"),
    ("Behewadali Imaging Corporation", "Behewadali"), ("Teniyugoru Camera Works", "Teniyugoru_Cameraworks"), ("Hupocozaru Optical Co., Ltd.", "Optical Company Hupocozaru"), ("Zarurahafo Imaging Corp.", "Zarurahafo Img Corporation"),
]
OTHER = [
    ("Alexander Fokirefura", "Charlotte Fokirefura"), ("Alexander Fokirefura", "C. Fokirefura"), ("Patrick L. Rilejekiyu", "Patrick Lutacuhegu"), ("The Guputipoco Sessions, Vol. 1", "Guputipoco Sess. v2"),
    ("Nights in Gifexohume", "Letters to Gifexohume and Other Stories"), ("Fokirefura Chamber Orchestra", "The Fokirefura Quartet"), ("Behewadali Imaging Corporation", "Vegozabafu Imaging Corporation"), ("Patrick L. Rilejekiyu", "Patrick L. Tihikikuca"),
]


def pairs(spark, listed):
    rows = [("f", n) for n in listed]
    return {(r.name_a, r.name_b) for r in names.variant_pairs(spark.createDataFrame(rows, "field string, name string")).collect()}


def test_variants_and_relatives(spark):
    found = pairs(spark, [n for p in SAME + OTHER for n in p] * 2 + [None, "", " ", "--", "x" * 3000])
    assert [p for p in SAME if tuple(sorted(p)) not in found] == []
    assert [p for p in OTHER if tuple(sorted(p)) in found] == []
    assert all(a < b for a, b in found)


def test_names_of_listed_words_only(spark):
    same = [("George Michael", "george michael"), ("George Michael", "Michael, George"), ("Jack Johnny", "JACK  JOHNNY"), ("Chamber Orchestra", "Ch. Orch."), ("The Band", "Band, The"), ("The Band", "band"), ("The The", "the the")]
    other = [("George Michael", "George James"), ("The Band", "The Who"), ("Jack Johnny", "Jack")]
    found = pairs(spark, [n for p in same + other for n in p])
    assert [p for p in same if tuple(sorted(p)) not in found] == [] and [p for p in other if tuple(sorted(p)) in found] == []


def test_short_and_joined_tokens(spark):
    same = [("U2", "u2"), ("LG", "L.G."), ("L.G.", "lg"), ("HP", "H P"), ("AC/DC", "ac dc"), ("東京", "東京 "), ("Sony", "Snoy"), ("Leica", "Leca"), ("Bluebird", "Blue Bird"), ("Vopi", "Vopa")]
    other = [("U2", "U3"), ("LG", "HP"), ("Sony", "Sino"), ("AC/DC", "ac db"), ("Bluebird", "Blue Birch")]
    found = pairs(spark, [n for p in same + other for n in p])
    assert [p for p in same if tuple(sorted(p)) not in found] == [] and [p for p in other if tuple(sorted(p)) in found] == []


def test_fields_are_apart(spark):
    d = spark.createDataFrame([("a", "Alex Fokirefura"), ("b", "Alexander Fokirefura")], "field string, name string")
    assert names.variant_pairs(d).count() == 0 and names.variant_pairs(d.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "bd", 2), ("abc", "xyz", 3), ("", "ab", 2), ("abcdef", "badcfe", 3)])
def test_edits(a, b, d):
    assert names.edits(a, b) == d == names.edits(b, a)


def test_similar_tokens_like_all_pairs(spark):
    import random

    rnd = random.Random(2)
    words = {"".join(rnd.choice("abcde") for _ in range(rnd.randrange(5, 9))) for _ in range(150)}
    got = {(r.a, r.b) for r in names.similar_tokens(spark.createDataFrame([("f", w) for w in words], "field string, token string")).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert got == {(a, b) for a in words for b in words if a < b and lev(a, b) <= 2}
