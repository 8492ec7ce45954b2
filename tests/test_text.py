import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import dates, html, text
from tests_util import plain_tokens

GOLDEN = {
    "火车站": ["火", "车", "站", "火车", "车站"],
    "茶": ["茶"],
    "開門": ["开", "门", "开门"],
    "國": ["国"],
    "他在Berlin讀書": ["他", "在", "他在", "Berlin", "读", "书", "读书"],
    "１９８４年": ["1984", "年"],
    "ＸＹＺ": ["XYZ"],
    "north；；south……": ["north", "south"],
    "？！、": [],
    "  ": [],
    "早安，朋友": ["早", "安", "早安", "朋", "友", "朋友"],
    "up\tdown left": ["up\tdown", "left"],
    "€9 = q|r": ["€9", "=", "q|r"],
    "佐々木": ["佐", "々", "木"],  # the mark is outside of the character class
    "ｻｸ": ["サ", "ク", "サク"],
    "🚲 go": ["🚲", "go"],
    "e\u0301te\u0301": ["été"],
    "ﬁn ²": ["fin", "2"],
}


def tokens(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.tokens(F.col("t")).alias("ts")).collect()
    return [r["ts"] for r in sorted(rows)]


def test_golden_tokens(spark):
    assert dict(zip(GOLDEN, tokens(spark, GOLDEN))) == GOLDEN
    assert tokens(spark, [None, ""]) == [[], []]


def test_tokens_equal_a_walk(spark):
    import random

    rnd = random.Random(4)
    alphabet = "ab Z9é\t\n，。.-開門讀车站々〇サク・ヴ$+|🚲２Ａ　한\u0301½"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    folds = str.maketrans(*text.folding())
    assert tokens(spark, texts) == [plain_tokens(t, folds) for t in texts]


def test_folding(spark):
    a, b = text.folding()
    table = dict(zip(a, b))
    assert len(a) == len(b) == len(table) > 2000 and not set(table.values()) & set(table)
    assert all(table[x] == y for x, y in zip("開門國機語讀書車關", "开门国机语读书车关"))


def test_folding_table_of_ones_own(spark, tmp_path):
    table = tmp_path / "folds.tsv"
    table.write_text("門\t门\n甲\t乙\n乙\t丙\n", encoding="utf-8")
    twice, long = tmp_path / "twice.tsv", tmp_path / "long.tsv"
    twice.write_text("門\t门\n門\t問\n", encoding="utf-8")
    long.write_text("門\t门门\n", encoding="utf-8")
    try:
        spark.conf.set(text.FOLDS, f"file://{table}")
        assert tokens(spark, ["門", "甲", "乙", "國"]) == [["门"], ["乙"], ["丙"], ["國"]]
        for wrong in (twice, long):
            spark.conf.set(text.FOLDS, f"file://{wrong}")
            with pytest.raises(ValueError):
                text.folding()
    finally:
        spark.conf.unset(text.FOLDS)
    assert tokens(spark, ["國"]) == [["国"]]


def test_traditional_and_simplified_are_one(spark):
    assert tokens(spark, ["他的書車", "關門讀國語"]) == tokens(spark, ["他的书车", "关门读国语"])


@pytest.mark.parametrize(
    ("page", "want"),
    [("<div>up<div>down</div></div>", "up down"), ("east<br/>west<hr>south", "east west south"), ("<ul><li>one  <i>two</i>\n<li>three</ul>", "one two three"), ("in<em>side</em>", "inside"), ('<h2 title="no">yes</h2><img alt="none">', "yes"), ("", ""), (None, ""), ("<p>end</p>less", "endless"), ("l<!-- gone -->r", "lr"), ("<script>1&lt;2</script>3", "1&lt;23"), ("x &lt; y &nbsp;&middot; z", "x < y · z"), ("k</p>l</br>m", "k l m"), ("<p>not<u>shut", "notshut")],
)
def test_html_to_text(page, want):
    assert html.text_of(page) == want


FOLDS = str.maketrans("開門讀", "开门读")


@pytest.mark.parametrize(
    ("page", "found", "want"),
    [
        ("<p>一起开门吧</p>", ["开门", "开", "门"], "<p>一起<mark>开门</mark>吧</p>"),
        ("<div>一起開門吧</div>", ["开门", "门"], "<div>一起<mark>開門</mark>吧</div>"),
        ("<p>Old Trains run</p>", ["trains"], "<p>Old <mark>Trains</mark> run</p>"),
        ("<p>他在Berlin</p>", ["berlin"], "<p>他在<mark>Berlin</mark></p>"),
        ("<b>slow, very slow</b>", ["slow"], "<b><mark>slow</mark>, very <mark>slow</mark></b>"),
        ("<p>１９８４</p>", ["1984"], "<p><mark>１９８４</mark></p>"),
        ('<a title="trains" href="/trains">here</a>', ["trains"], '<a title="trains" href="/trains">here</a>'),
        ("<p>nothing asked</p>", [], "<p>nothing asked</p>"),
        ("<p>朋友</p>", ["开门"], "<p>朋友</p>"),
        ("p &lt;q&gt; r", ["q"], "p &lt;q&gt; r"),  # the run is "<q>": symbols are part of it
        ("<p>north<p>south", ["south"], "<p>north</p><p><mark>south</mark></p>"),
        ("门 开门", ["开门"], "门 <mark>开门</mark>"),
        ("开门读", ["开门", "门读"], "<mark>开门读</mark>"),
        (None, ["a"], None),
    ],
)
def test_highlight(page, found, want):
    assert html.highlighted(page, found, FOLDS) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab <>&开门\n-x", max_size=30), st.lists(st.sampled_from(["a", "ab", "开", "开门", "x"]), max_size=3))
def test_marks_do_not_change_the_text(raw, found):
    from html import escape

    page = "<p>" + escape(raw) + "</p>"
    assert html.text_of(html.highlighted(page, found, FOLDS)) == html.text_of(page)


def test_relative_time(spark):
    now = F.lit("2031-03-10 18:00:00").cast("timestamp")
    cases = {
        "2031-03-10T17:59:20Z": "剛剛", "2031-03-10T17:43:00Z": "17 分鐘前", "2031-03-10T11:10:00Z": "7 小時前", "2031-03-09T17:00:00Z": "昨天", "2031-03-08T20:00:00Z": "前天",
        "2031-03-06T18:30:00Z": "4 天前", "2031-01-02T18:00:00Z": "1月2日", "2029-12-31T23:00:00Z": "2029年12月31日", "soon": "", "2031-03-10T18:26:00Z": "26 分鐘後", "2031-03-11T19:00:00Z": "明天",
        "2031-03-12T19:00:00Z": "後天", "2031-03-10T17:00:12Z": "60 分鐘前", "2031-03-10T17:00:00.100Z": "1 小時前", None: "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", dates.relative_time(F.col("t"), now).alias("r")).collect()
    assert {r["t"]: r["r"] for r in rows} == cases


def test_rounding_halves_go_up(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.5, -0.5, -1.5, 2.4)], "x double").select(dates.rounded(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in rows] == [1, 2, 0, -1, 2]


def test_entity_without_a_semicolon():
    assert html.text_of("<title>a &amp</title><p>b") == "a & b"
