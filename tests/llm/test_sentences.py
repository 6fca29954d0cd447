import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import sentences as S


def cut(text, lang=None, section=None):
    return [text[a:b] for a, b in S.sentence_spans(text, lang, section)]


#: Sentences are joined by | in the expectation.
CASES = [
    ("It drifts, e.g. at 3.3 V, i.e. below Fig. 2. See Sec. 4.1 (cf. No. 7).  It ends!", "It drifts, e.g. at 3.3 V, i.e. below Fig. 2.|See Sec. 4.1 (cf. No. 7).|It ends!"),
    ("Filed in the U.S. and in the E.U. today. First filed in the U.S. Neither cell drifts. Lists weights, etc. without memory.", "Filed in the U.S. and in the E.U. today.|First filed in the U.S.|Neither cell drifts.|Lists weights, etc. without memory."),
    ('The label "Stop. Reset it." is printed. He calls it "idle." Then it ends. “What fails?” is asked.', 'The label "Stop. Reset it." is printed.|He calls it "idle."|Then it ends.|“What fails?” is asked.'),
    ("(See also Table 1.) A cell (see Fig. 2) is read.", "(See also Table 1.)|A cell (see Fig. 2) is read."),
    ("It reads ctrl_v2.6.cfg and prunes. x.y coordinates are stored in col. 5. eDRAM cells keep it.", "It reads ctrl_v2.6.cfg and prunes.|x.y coordinates are stored in col. 5.|eDRAM cells keep it."),
    ("It drifts, settles… and forwards. Is it stable at all?! Yes.", "It drifts, settles… and forwards.|Is it stable at all?!|Yes."),
    ("One ends.Two begins in col. 5.Class three.", "One ends.|Two begins in col. 5.|Class three."),
    ("THE CORE (CF. SEC. 2.5) IS FILED IN THE U.S. AND IN THE E.U. IN SILENCE. IT ENDS.", "THE CORE (CF. SEC. 2.5) IS FILED IN THE U.S. AND IN THE E.U. IN SILENCE.|IT ENDS."),
    ("Am 2. März wurde die 2. Stufe, z. B. im Ruhezustand, geprüft. Es nennt Puffer usw. Es endet, d. h. bzw. Abb. 5. Ende.", "Am 2. März wurde die 2. Stufe, z. B. im Ruhezustand, geprüft.|Es nennt Puffer usw.|Es endet, d. h. bzw. Abb. 5.|Ende."),
    ("Il note : « La boucle manque. Veuillez préciser. » avant de conclure. L'art. 6, p. ex., dérive d'env. 6,50 % ! Comment ?", "Il note : « La boucle manque. Veuillez préciser. » avant de conclure.|L'art. 6, p. ex., dérive d'env. 6,50 % !|Comment ?"),
    ("¿Cómo responde? El doc. núm. 6.892 de EE. UU. la cita. ¡Fin!", "¿Cómo responde?|El doc. núm. 6.892 de EE. UU. la cita.|¡Fin!"),
    ("审查员写道：“缺少电路。请补充。”并予以驳回。如图1.9所示（参见第1页。）累加；存储．先漂移……随后丢弃。结束！", "审查员写道：“缺少电路。请补充。”并予以驳回。|如图1.9所示（参见第1页。）累加；存储．|先漂移……随后丢弃。|结束！"),
    ("「停止！」という表示がある。電圧は1.53 Vである！　終わり？", "「停止！」という表示がある。|電圧は1.53 Vである！|終わり？"),
    ("चित्र सं. 8 के अनुसार है। डॉ. पद है । अंत?", "चित्र सं. 8 के अनुसार है।|डॉ. पद है ।|अंत?"),
    ("انظر ص. 7 بشأن الدائرة. كتب: «تنقص. يرجى الإضافة.» ثم رفض؛ انتهى. كيف؟", "انظر ص. 7 بشأن الدائرة.|كتب: «تنقص. يرجى الإضافة.» ثم رفض؛ انتهى.|كيف؟"),
    ("วงจรใช้ GPU ร่วมกับบัฟเฟอร์ แรงดันมีค่า 3.19 โวลต์ซึ่งต่ำ วงจรคืนค่าอย่างไร? ตามรูปที่ 3 วงจรอ่าน It ends. จบ", "วงจรใช้ GPU ร่วมกับบัฟเฟอร์|แรงดันมีค่า 3.19 โวลต์ซึ่งต่ำ|วงจรคืนค่าอย่างไร?|ตามรูปที่ 3 วงจรอ่าน|It ends.|จบ"),
]


#: Abbreviations that are words too, of other languages, before labels and names.
ABBREVIATIONS = [
    "The answer is no.|We continue with it.",
    "They sell art.|Buyers come daily.",
    "He opened the app.|Nothing happened.",
    "The input is max.|The output is min.|The rest is temp.|Done.",
    "Vitamin C.|It helps.",
    "Pick plan B.|Then go.",
    "It is one of the kind.|See ref.|Then stop.",
    "It is prior art.|The core is new.|It is 5 mm.|Then 10 min.|After that it ends.",
    "Die eingangs genannte Art.|Die Form ist neu, vgl. Abb. 5 und Abs. B der Schrift.",
    "Он живёт в г. Москва и работает, см. рис. 5 и стр. 7.|Это всё, что есть.",
    "J. Smith came with Dr. Brown to No. 5 of Fig. A and Sec. IV of it.|Max. voltage is read, and max. 5 of them.",
    "Il voit M. Dupont et Mme. Blanc dans la rue.|Les autres sont p. ex. ici.",
]


@pytest.mark.parametrize("want", ABBREVIATIONS)
def test_abbreviations_of_the_language(want):
    assert cut(want.replace("|", " ")) == want.split("|")


def test_languages():
    assert S.languages("Die Zelle ist in der Bank und misst.", "en") >= {"de"} and "en" not in S.languages("Die Zelle ist mit der Bank.", "xx")
    assert S.languages("", "fr") == {"fr"} and S.languages("Kern", None) == {"en"} and "hi" in S.languages("यह है", "en") and S.languages("これは", None) == {"en"}
    assert S.languages("The cell is read. Die Zelle ist mit der Bank.") == {"en", "de"}


@pytest.mark.parametrize("text, want", CASES)
def test_scripts(text, want):
    assert cut(text) == want.split("|")


def test_layout():
    text = "1. Overview\nThe first cell drifts under thermal load, and the second cell of the\narray is read. It ends.\r\n \r\n- one item\n- another item;\n\nBACKGROUND\nIn one embodiment, it ends."
    assert cut(text, "en", "description") == ["1. Overview", "The first cell drifts under thermal load, and the second cell of the\narray is read.", "It ends.", "- one item", "- another item;", "BACKGROUND", "In one embodiment, it ends."]


def test_claims():
    text = "1. A core comprising:\n    a cell that stores;\n    at least one die; and\n    a bank, e.g. at 3.3 V.\n2. The core of claim 1."
    assert cut(text, "en", "claims") == [text.split("\n2")[0], "2. The core of claim 1."]


def test_remarks_and_code():
    assert cut("why is it software?? 🤔\nok!\nnot sure? w/o it nothing is left.", "en", "note") == ["why is it software?? 🤔", "ok!", "not sure?", "w/o it nothing is left."]
    assert cut("if (w[3]!=0)\t{acc+=x<<1;}\nG06F7/1;;G06F9/2", "en", "codes") == ["if (w[3]!=0)\t{acc+=x<<1;}", "G06F7/1;;G06F9/2"]


@pytest.mark.parametrize("text", [None, "", " \n\t　\xa0"])
def test_nothing(text):
    assert S.sentence_spans(text) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='aA1 .!?"()\n…。ก«»“”;-', max_size=120))
def test_spans_are_sound(text):
    at = 0
    for a, b in S.sentence_spans(text):
        assert at <= a < b <= len(text) and text[a:b] == text[a:b].strip()
        assert not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_very_long_text():
    spans = S.sentence_spans('He said "no." Then it ended (see Fig. 2). ' * 3000, "en")
    assert len(spans) == 6000


def test_operator(spark):
    x = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, "")], "doc_id long, text string")
    rows = [tuple(r) for r in S.split_sentences(x).collect()]
    assert sorted(rows) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
