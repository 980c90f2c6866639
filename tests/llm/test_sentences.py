import pytest
from pyspark.sql import functions as F

from arclume.llm.sentences import sentence_ends, sentence_units
from helpers import rows

#: Texts with | where a unit ends.
CASES = [
    "Works now, thanks to St. Ilvane!| Dr. J. R. Marsk vs. the proxy (cf. Fig. 1) is slow.| It needs approx. 4,370.36 ms.|",
    "We tried locks, etc.| Our host is up.| Check tags, etc. and try again.| It ends at 2 a.m.| It began at 4:16 p.m. on the host.|",
    "The error says “No lock found. Abort.” and then it stops.| The manual says: \"It opens the tag.\"| My build fails.| \"Does it?\" asked Mr. Kastrel at night.|",
    "So ... the cache is fine?!| It truncates the view ...| The rest is missing ..| (The tag blocks it, too.)| It works (see sect. 2.2).| Call `a.b(c. D)` first.|",
    "It works.npm fails!| iptables hides it.| npm leaks at night.|".replace("works.npm", "works.| npm"),
    "Anything else.|The host is up!|Danke, das läuft.|",
    "It returns No. 409.| First stop.| I said no.| Then stop.|",
    "See https://a.example/v2.1/notes.txt for it.| http://b.test/x?id=8 is dead.| Mail a.b@c.example now.|",
    "Am 28. Juni hat Dr. Pellwyn ca. 4,5 s gemessen.| „Läuft das noch?“, fragte Hr. Tavrin.| Ich nutze z. B. app.log, d. h. den Index usw. auch hier.| Siehe Nr. 15 hier.|",
    "« C'est normal ? » demande Mme Limmick.| Pourquoi ?| M. Marsk propose p. ex. main.rs, cf. la doc.|",
    "¿Por qué falla?| El Sr. Arbrey usa, p. ej., app.log.| «No toques nada.» fue la respuesta de la Dra. Tavrin.| Véase la pág. 11 del manual.|",
    "Смотри рис. 2 и стр. 58 тут.| «Это нормально?» — спросил г. Marsk.| Журналы и т. д. лежат тут.| Всё, т. е. файл, растёт.|",
    "Γιατί κολλάει;| Ο κ. Sedrow προτείνει π.χ. το app.log εδώ.| Ευχαριστώ!|",
    "他说：“缓存没有问题。不要再改了。”然后就走了。|文档写着：“服务器很慢。”|谢谢！|请看http://a.test/v2.1/x 这个页面……但是失效。|值是6.62，好！|",
    "「正常です。触らないで。」と言われました。|（夜中に止まります。）|値を6.4にしても止まります！|なぜですか？|",
    "安静的运河交换了……|我把app.log改了！|奏者が重い……|「ログは正常です。」と言われました。|重い……|data.gzの値です。|",
    "왜 그렇게 됩니까?| 값을 3.4로 바꿔도 멈춥니다!| app.log 파일이 정상입니다.|",
    "ขอบคุณครับ| ทำไมช้าครับ| แก้ไฟล์ setup.cfg เป็น 5.92 แล้วหายไปค่ะ|",
    "धन्यवाद, अब ठीक है!| डॉ. Marsk के अनुसार 4.3 सेकंड।| क्यों?|",
    "لماذا؟| يقول د. سالم إنه يتوقف كل 2.5 ثانية.| شكرا!|",
    "# v2.0 vs. v1.9|\nText here\nand there.| More\n\nNext|\n\n- one. Two.|\n- three|\n\n1. first|\n2. second.| More|\n\nhttp://a.test/x.y|\n\n".replace("one. Two.", "one.| Two.").replace("there.| More\n\n", "there.| More|\n\n"),
    "Before:|\n\n```py\nprint('a. B')\n\n# done. Go.\n```|\nAfter.|\n\n    x = 1. Y\n    z = 2|\n\n~~~\nopen. Never closed|",
    "> quoted text. It goes\n> on. And on.|".replace("text. It", "text.| It").replace("on. And", "on.| And"),
    "EDIT: (It is up, too.)| PS: it's \"fine\"|\n\nWorks for me 👍|",
    "It is <b>near **St.** Marsk.</b>| **One** more.**| Two __ends.__&nbsp;|Three.|".replace(".**|", ".|").replace("&nbsp;|", "|&nbsp;"),
    "He said (it fails :( and so on.| Never mind.|",
    "The U.S. Army won.| They live in the U.S.| The host is up.|",
]


@pytest.mark.parametrize("marked", CASES)
def test_units(marked):
    text = marked.replace("|", "")
    want, at = [], 0
    for part in marked.split("|")[:-1]:
        at += len(part)
        want.append(at)
    got = sentence_ends(text)
    show = lambda ends: [text[a:b].strip() for a, b in zip([0, *ends], ends)]
    assert show(got) == show(want)
    assert got == want


def test_defined_results():
    assert sentence_ends(None) == sentence_ends("") == sentence_ends(" \n\n \t") == []
    assert sentence_ends("  a  ") == [3]
    assert sentence_ends("...") == [3]
    assert sentence_ends("😀 Yes. 😀") == [6, 8]
    long = "It is so. " * 50_000
    assert len(sentence_ends(long)) == 50_000
    assert len(sentence_ends("(" * 20_000 + "a. B." + ")" * 20_000)) >= 1
    assert len(sentence_ends('"' * 9_999 + " a. B.")) >= 1
    for text in ("“” “ a. B", "a.. ..b", "```", "    code", "- ", "1.", "\x00.\x00", "A. B."):
        ends = sentence_ends(text)
        assert ends == sorted(set(ends)) and (not ends or ends[-1] == len(text.rstrip()))


def test_sentence_units(spark):
    df = spark.createDataFrame([(1, "One. Two!"), (1, "One. Two!"), (2, None), (3, ""), (None, "𝒳 is. Here")], "doc_id long, text string").withColumn("sent_end", F.lit("clash"))
    got = sentence_units(df)
    assert rows(got.select("doc_id", "sent_no", "sent_start", "sent_end", "sentence")) == [
        (1, 0, 0, 4, "One."), (1, 0, 0, 4, "One."), (1, 1, 5, 9, "Two!"), (1, 1, 5, 9, "Two!"), (None, 0, 0, 5, "𝒳 is."), (None, 1, 6, 10, "Here"),
    ]
    assert sentence_units(df.limit(0)).count() == 0
    short = sentence_units(df, with_text=False)
    assert short.columns == ["doc_id", "sent_no", "sent_start", "sent_end"] and rows(short) == rows(got.drop("sentence"))
    many = sentence_units(spark.createDataFrame([(1, "One two. " * 30_000)], "doc_id long, text string"), keep=("doc_id", F.lit("x").alias("kind")))
    assert many.count() == 30_000 and many.filter("sent_end - sent_start = 8 and sentence = 'One two.' and kind = 'x'").count() == 30_000
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_many_unclosed_openers():
    sad, rest = ["It is down =( at night."] * 40, ["The error says “No lock found. Abort.” and then it stops.", "(It works. It does.)"]
    text, ends, at = " ".join(sad + rest), [], -1
    for s in sad + rest:
        at += 1 + len(s)
        ends.append(at)
    assert sentence_ends(text) == ends
    assert len(sentence_ends("It is down =( at night. " * 20_000 + "(It works. It does.)")) == 20_001
