"""Refusals, found by aligning an answer with templates of several languages.

A template is a row of slots; a slot takes one of several words and has a weight, high for words that decide. An answer is aligned with
a template by weighted longest common subsequence: slots that find no word lose their weight, words between matched slots cost a
little each. Where ``ALIGNED`` of a template's weight is reached, the answer declines. Templates are put together from the parts of
a refusal (who, can't, does what), so that wordings needn't be listed one by one; alignment starts only at words that decide.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product

ALIGNED = 0.85
#: What a word between two matched slots costs, and how many words at most are looked at on either side of a deciding one.
GAP, REACH = 0.1, 12

# Words that take the same slot.
CLASSES = {
    "I": "i we",
    "ACT": "accept accommodate accomplish address analyse analyze answer assist attempt carry comment complete comply compose construct continue convert create deal decipher define deliver "
    "depict describe design determine display do draft draw evaluate execute explain extract finish follow fulfil fulfill generate give handle help identify illustrate interpret judge look make "
    "manage meet obey offer open output paint perform proceed process produce provide read recognise recognize render reply respond review satisfy say see share show sketch solve supply "
    "support take tell transcribe translate trace undertake view work write",
    "ACTING": "answering assisting commenting complying creating describing designing doing drawing generating giving helping judging looking making offering producing providing reading "
    "responding taking transcribing viewing writing",
    "DECLINE": "decline refuse pass skip abstain refrain opt",
    "MUST": "must have need will shall going choose chose prefer am afraid decided think rather",
    "REQUEST": "request task question prompt query instruction work kind sort drawing this",
    "DECLINED": "declined denied refused rejected unsupported impossible",
    "RULES": "guidelines guideline policy policies rules rule principles programming instructions training settings",
    "ALLOW": "allow permit let enable",
    "ABILITIES": "abilities ability capabilities capability skills scope remit expertise reach",
    "HELPER": "designer designers professional expert specialist else illustrator typographer tool someone somebody",
    "MODEL": "model ai assistant bot chatbot program",
}
# Ways to say that something can't be done; contractions are written out before.
CANNOT = (
    "cannot", "can not", "could not", "may not", "must not", "will not", "can no longer", "am unable to", "am not able to", "am not allowed to", "am not permitted to", "am not capable of",
    "am not equipped to", "am not designed to", "am not trained to", "am not in a position to", "am not comfortable", "am not willing to", "am not going to", "will not be able to", "would not be able to",
    "do not have the means to", "do not have the ability to", "do not have the tools to", "do not feel comfortable", "lack the means to", "lack the ability to", "lack the tools to", "prefer not to",
    "would prefer not to", "would rather not", "choose not to", "have decided not to", "have decided against", "have no way to", "have no means to", "are unable to", "are not able to",
)
# Templates; words in capitals are classes, ``a|b`` are alternatives, ``word?`` counts little.
TEMPLATES = """
I MUST DECLINE
I MUST to? DECLINE
I respectfully? DECLINE to|this|that|your|doing
I MUST sit this? out
I will sit this
count me out
is|are not something I
not something|anything I can|could|will|would|do|offer
nothing I can|could|will|would ACT
outside|beyond of? what I can|do
beyond|outside|exceeds my|our ABILITIES
against|violates my|our RULES
my|our RULES do|does not ALLOW
do|does not ALLOW me|us to?
forbid|forbids|prevent|prevents me|us from?
not be? appropriate|possible|feasible|acceptable for? me|us
no answer|drawing|description|response will|can be? given|provided|made
REQUEST is|was|be|has|must been? DECLINED
REQUEST is|was not supported|possible|allowed|permitted
REQUEST cannot be? fulfilled|completed|answered|processed|met
cannot comply|assist|help with|that|this
cannot fulfill|fulfil|complete|process the|this|your|that
unable to? comply|assist|help|fulfill|fulfil|complete|answer|draw|generate|create|read|describe
I do not do|draw|provide|generate|create|offer|produce|support|answer|describe|judge|comment
please|kindly consult|contact|ask|find|try a|an|your|some|another|someone|somebody HELPER
as a|an language|large|ai|helpful? MODEL
I am just|only|merely a|an language|text|ai|simple|computer MODEL
I am just|only|merely a|an MODEL
I am sorry but
I am? sorry cannot|unable|not
I am afraid
I apologize|apologise but|that|for
unfortunately I cannot|am|do|will|have|must
regret that? I cannot|am|must
"""
# Templates of other languages; characters of Chinese and Japanese are words, ``~`` stands for words of any number up to a few.
ELSEWHERE = """
ich|wir kann|können|konnte|darf|werde ~ nicht|kein|keine|keinen
leider kann|können|bin|muss|darf ich|wir
kann|können ich|wir ~ leider|nicht
tut mir|uns leid
muss|möchte ich|wir ~ ablehnen|verweigern|passen
nicht in der? lage
je|nous ne? peux|pouvons|puis|saurais pas
je ne? suis pas en|capable|autorisé|autorisée
je dois|préfère|souhaite refuser|décliner|passer
je suis désolé|désolée mais
désolé|désolée|malheureusement ~ pas|impossible
il m'est|est impossible de
no puedo|podemos|podré|logro ACTS|hacer|ayudar|dibujar|crear|generar|describir|leer|ver|cumplir|responder|continuar|eso|esto|con
lo siento|lamento pero|no|mucho
me temo que? no|eso
debo|tengo|prefiero que? rechazar|negarme|declinar
non posso|possiamo|riesco|sono in|grado|aiutare|disegnare|creare|generare|descrivere|leggere|farlo|rispondere|soddisfare|fornire
mi dispiace ma|non|tanto
devo|preferisco rifiutare|declinare
não posso|podemos|consigo ~ ajudar|desenhar|criar|gerar|descrever|ler|fazer|responder|atender|fornecer|isso
sinto|lamento muito|mas|não
nie mogę|możemy|potrafię|zdołam
nie jestem|jesteśmy w stanie
przykro mi|nam
muszę|wolę odmówić
ik|wij kan|kunnen|mag ~ niet|geen
het spijt me|mij|ons
jag|vi kan|får ~ inte
tyvärr kan|måste|är
nemohu|nemůžu|neumím ~ pomoci|pomoct|nakreslit|vytvořit|popsat|přečíst|splnit|odpovědět|to
bohužel ~ nemohu|nemůžu|nelze|neumím
omlouvám se ale|nemohu
üzgünüm|maalesef ~ yapamam|çizemem|edemem|veremem|oluşturamam|okuyamam|mümkün
không thể vẽ|tạo|giúp|mô|đọc|thực|trả|làm|đáp|cung
xin lỗi ~ không|nhưng|vì
tôi không thể
я|мы не могу|можем|умею|буду
не могу|можем помочь|выполнить|нарисовать|описать|прочитать|создать|ответить|это
к сожалению ~ не|вынужден|вынуждена
извините|простите ~ не|но
вынужден|вынуждена отказать|отказаться|отклонить
δεν μπορώ|μπορούμε|δύναμαι
λυπάμαι ~ δεν|αλλά
で き ま せ ん
い た し か ね ま す
申 し 訳
お 断 り
无 法
抱 歉
不 能 提|完|回|帮|画|生 供|成|答|助|图
拒 绝
할 수 없 습|어
죄 송 합|하
"""
# Words that alone decide nothing.
LIGHT = frozenset("a an the to of for on in at that this is are am was be been being do does have has and so by from with you your it but very me us our my ne se je ich i we".split())
_SHORT = (("can't", "cannot"), ("won't", "will not"), ("shan't", "shall not"), ("n't", " not"), ("'m", " am"), ("'re", " are"), ("'d", " would"), ("'ll", " will"), ("'ve", " have"))
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]|[^\W_]+(?:['’][^\W_]+)*")

Slot = tuple[frozenset[str], float]


def tokens(text: str) -> list[str]:
    """Words in lower case, contractions written out; characters of Chinese, Japanese and Korean one by one."""
    text = text.casefold().replace("’", "'")
    for short, long in _SHORT:
        text = text.replace(short, long)
    return [w for w in _WORD.findall(text)]


def _slot(text: str) -> Slot:
    words = [w for part in text.rstrip("?").split("|") for w in (CLASSES.get(part, part).split() if part.isupper() and len(part) > 0 and part in CLASSES else [part])]
    light = text.endswith("?") or text == "I" or all(w in LIGHT for w in words)
    return frozenset(w.casefold() for w in words), 0.35 if text.endswith("?") else 0.6 if light else 1.0


def _template(line: str) -> tuple[tuple[Slot, ...], int]:
    """The slots of a line and how many words may stand between them without cost."""
    parts = line.split()
    return tuple(_slot(p) for p in parts if p != "~"), 8 * parts.count("~")


@cache
def templates() -> tuple[tuple[tuple[Slot, ...], int], ...]:
    """All templates: who can't do what, put together, and the others."""
    made = [f"I {cannot} {act}" for cannot, act in product(CANNOT, ("ACT", "ACTING")) if (act == "ACTING") == cannot.endswith(("of", "against", "comfortable"))]
    made += [f"{cannot} {act}" for cannot, act in product(("not able to", "not allowed to", "not permitted to"), ("ACT",))]
    lines = [*made, *TEMPLATES.strip().splitlines(), *ELSEWHERE.strip().splitlines()]
    return tuple(_template(line) for line in lines)


@cache
def _deciding() -> dict[str, tuple[int, ...]]:
    """Templates by the words of the heaviest slot that takes fewest words: any alignment that reaches ``ALIGNED`` has that slot."""
    out: dict[str, list[int]] = {}
    for k, (slots, _) in enumerate(templates()):
        words = min(slots, key=lambda s: (-s[1], len(s[0])))[0]
        for w in words:
            out.setdefault(w, []).append(k)
    return {w: tuple(ks) for w, ks in out.items()}


def score(slots: tuple[Slot, ...], said: list[str], free: int = 0) -> float:
    """The share of a template's weight that the best alignment with some stretch of ``said`` reaches; ``free`` words in between cost nothing."""
    whole = sum(weight for _, weight in slots)
    best = 0.0
    # ahead[j]: the best sum of an alignment whose last matched word is said[j], with the free words left to it
    ahead: list[tuple[float, int]] = [(0.0, free)] * len(said)
    for words, weight in slots:
        now = list(ahead)
        run: tuple[float, int] | None = None  # the best one that ends before j, its gap paid
        for j, word in enumerate(said):
            if word in words:
                start = run if run and run[0] > 0 else (0.0, free)
                if start[0] + weight > now[j][0]:
                    now[j] = (start[0] + weight, start[1])
            if run:
                run = (run[0], run[1] - 1) if run[1] else (run[0] - GAP, 0)
            if ahead[j][0] > 0 and (run is None or ahead[j][0] > run[0]):
                run = ahead[j]
        ahead = now
        best = max(best, max((v for v, _ in ahead), default=0.0))
    return best / whole


def refuses(answer: str) -> bool:
    """Whether some stretch of the answer aligns with a refusal template."""
    said = tokens(answer)
    known, seen = templates(), set()
    for at, word in enumerate(said):
        for k in _deciding().get(word, ()):
            slots, free = known[k]
            reach = REACH + free
            window = (k, max(0, at - reach) // reach)
            if window in seen:
                continue
            seen.add(window)
            begin = window[1] * reach
            if score(slots, said[begin : begin + 3 * reach], free) >= ALIGNED:
                return True
    return False
