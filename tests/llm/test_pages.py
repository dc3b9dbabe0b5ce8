"""Main text of pages built from known blocks, in languages with and without a word list and in several layouts."""

import random

import pytest

from sparklode.llm.html_extract import main_text

SENTENCES = {
    "en": ["The river rose over its banks in the night and the people of the valley left their houses.", "It was the third flood of that year, and nobody had thought that it would come so early."],
    "de": ["Der Fluss trat in der Nacht über die Ufer, und die Leute aus dem Tal verließen ihre Häuser.", "Es war das dritte Hochwasser in diesem Jahr, und niemand hatte es so früh erwartet."],
    "it": ["Il fiume è uscito dagli argini nella notte e la gente della valle ha lasciato le case.", "Era la terza piena di quell'anno e nessuno pensava che sarebbe arrivata così presto."],
    "ru": ["Ночью река вышла из берегов, и жители долины покинули свои дома.", "Это было третье наводнение в том году, и никто не думал, что оно придёт так рано."],
    "ar": ["فاض النهر على ضفتيه في الليل وترك أهل الوادي بيوتهم.", "كان هذا هو الفيضان الثالث في تلك السنة ولم يظن أحد أنه سيأتي مبكرا."],
    "tr": ["Nehir gece yatağından taştı ve vadinin halkı evlerini bırakıp gitti.", "Bu o yılın üçüncü seliydi ve kimse bu kadar erken geleceğini düşünmemişti."],
    "fi": ["Joki tulvi yöllä yli äyräidensä, ja laakson asukkaat jättivät talonsa.", "Se oli sen vuoden kolmas tulva, eikä kukaan ollut uskonut sen tulevan niin varhain."],
    "el": ["Το ποτάμι ξεχείλισε τη νύχτα και οι άνθρωποι της κοιλάδας άφησαν τα σπίτια τους.", "Ήταν η τρίτη πλημμύρα εκείνης της χρονιάς και κανείς δεν την περίμενε τόσο νωρίς."],
    "zh": ["夜里河水漫过了堤岸，山谷里的人们离开了自己的家。", "这是那一年的第三次洪水，谁也没有想到它来得这么早。"],
    "ja": ["夜のうちに川が堤防を越え、谷の人々は家を離れた。", "それはその年で三度目の洪水で、これほど早く来るとは誰も思っていなかった。"],
    "ko": ["밤사이에 강물이 둑을 넘었고 골짜기 사람들은 집을 떠났다.", "그해의 세 번째 홍수였으며 그렇게 일찍 올 줄은 아무도 몰랐다."],
    "hi": ["रात में नदी अपने किनारों से ऊपर उठ गई और घाटी के लोग अपने घर छोड़ गए।", "यह उस साल की तीसरी बाढ़ थी और किसी ने नहीं सोचा था कि वह इतनी जल्दी आएगी।"],
}
MENU = "<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div id=top-links><a href=/c>C c c</a> <a href=/d>D d d</a></div>"
END = "<div class='share-buttons'><a href=x>X</a></div><div class=comments><p>{say}</p></div><footer><p>{say}</p></footer><div class='cookie-banner'><p>{say}</p></div>"
LAYOUTS = {
    "article": "<body>{menu}<article>{body}</article>{end}</body>",
    "main": "<body>{menu}<main>{body}</main>{end}</body>",
    "plain": "<body>{menu}<div>{body}</div>{end}</body>",
    "teaser": "<body>{menu}<div>{body}</div><article><a href=/n>N</a></article><article><h3>N n</h3></article>{end}</body>",
    "share-price": "<body>{menu}<div class='share-price'>{body}</div>{end}</body>",
    "more-about": "<body>{menu}<section id='more-about'>{body}</section>{end}</body>",
    "unclosed": "<body>{menu}<div><p>{unclosed}</div>{end}</body>",
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("language", SENTENCES)
def test_known_blocks(language, layout):
    rng = random.Random(f"{language} {layout}")
    space = "" if language in ("zh", "ja") else " "
    blocks = [space.join(rng.choices(SENTENCES[language], k=rng.randint(5, 9))) for _ in range(4)]
    say = space.join(SENTENCES[language] * 2)
    html = LAYOUTS[layout].format(menu=MENU, body="".join(f"<p>{b}</p>" for b in blocks), unclosed="<p>".join(blocks), end=END.format(say=say))
    assert main_text(html) == "\n".join(blocks)


def test_short_text_without_a_decided_block():
    text = "Ночью река вышла из берегов, и жители долины покинули свои дома."
    assert main_text(f"<body>{MENU}<p>{text} {text}</p><footer>{text}</footer></body>") == f"{text} {text}"


def test_doubtful_containers_lose_short_blocks():
    say = " ".join(SENTENCES["en"] * 3)
    assert main_text(f"<body><div><p>{say}</p></div><div class='more-links'><p>See also this</p><p><a href=x>{say}</a></p></div></body>") == say


def test_heading_goes_with_the_text_after_it():
    say = " ".join(SENTENCES["en"] * 3)
    assert main_text(f"<body><h1>Floods</h1><p>{say}</p><p>Short end.</p><h2>Links</h2><p><a href=x>{say}</a></p></body>") == f"Floods\n{say}\nShort end."
