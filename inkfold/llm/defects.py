"""Problem 1: broken prompt and response pairs, each with the type of its defect.

What can be told from counts (blank answers, paths that are missing or cut) is found in Spark's own expressions; only
answers that hold words go on to alignment, and of those only the words. Prompt and answer tokens are aligned by
shingle containment and longest common subsequence to find copies, refusal templates of several languages by weighted longest
common subsequence with gaps to find refusals (``refusals``); the language of sentences, by frequent words or else by character pairs and
triples, is compared with the prompt's; prose must come to an end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm.overlap import wanted_text
from inkfold.llm.refusals import refuses

SHINGLE = 3
CONTAINED = 0.6
COMMON = 0.8
#: Least words for a language to be told by their letters, and by how much it must be before the next.
GRAM_WORDS, MARGIN = 5, 1.0

# Words that stand for no answer.
NOTHING = frozenset("null none nil nan n/a na undefined empty no answer no output no response".split()) - {"no", "answer", "output", "response"} | {"no answer", "no output", "no response"}
# Words put before a repeated prompt.
ROLES = re.compile(r"^\W*(?:q|question|user|human|prompt|instruction|input|request|you said|you asked|you wrote)\s*:\s*", re.I)
# Frequent words of languages in Latin letters.
FREQUENT = {
    "en": "the of and to in is it for that with as was on are be this by at from but not have has had or an which their its they them his her you your we our will would can cannot could should may than then there here when where what who how all any some more most other into over under after before about these those so if no yes do does did been being such only also even just very one two per out up off between each follow follows letters answer text reads style wanted weight draw here sure",
    "de": "der die das den dem des ein eine einen einem einer und oder aber nicht ist sind war wird werden wirkt hat haben auf aus bei mit nach von vor zu zum zur für über unter durch im am ins sich auch als wie doch noch nur sehr hier dort diese dieser dieses größere wäre könnte kann müssen während eher kaum fällt bild zeigt text gerne folgen unten buchstaben gewünschte gewünschten pfad ich es man schon wenn dann bleibt läuft schließt eignet schrift zeichen",
    "fr": "le la les un une des du de et ou mais ne pas est sont était sera dans sur sous avec pour par sans ce cette ces cet son sa ses leur leurs qui que quoi dont où il elle ils elles on nous vous au aux plus moins très même après avant chez comme si voici bien sûr ci-dessous lettres tracé demandé image montre texte là garde reste paraît surtout devient trop quand composer été pensée l d s'agit",
    "es": "el la los las un una unos unas de del y o u pero no es son era fue está están ser en con por para sin sobre este esta estos estas ese esa su sus que quien cual donde cuando como más menos muy también todo toda todavía entre hasta desde aquí claro letras continuación trazado pedido imagen muestra texto además queda antes parece termina tenían usó mal llamará",
    "it": "il lo la gli le un uno una di del della dei delle e o ma non è sono era in con per da dal dalla su sul sulla che chi cui dove quando come più meno molto anche tutto tutta questo questa questi queste si ci ecco lettere tracciato immagine mostra testo carattere",
    "pt": "o os as um uma uns umas de do da dos das e ou mas não é são era em no na nos nas com por para sem sobre este esta isto que quem onde quando como mais menos muito também todo toda aqui letras seguem imagem mostra texto está",
    "pl": "i w na z ze do od dla po przy o oraz lub ale nie jest są był była było być się to ten ta te tego tej tym który która które jak gdy gdzie czy już tylko także bardzo więc tutaj każdy każda później oto żądana ścieżka litery poniżej oczywiście obrazku widać napis wygląda zbyt kończy inaczej powstał użyto go pozostaje spośród znaków poprawiono",
    "nl": "de het een en of maar niet is zijn was wordt worden in op aan met voor van naar bij uit door over onder dit dat deze die er ook nog wel zeer hier daar als dan letters afbeelding toont tekst ik je we ze heeft hebben",
    "sv": "och i att det som en ett på är av för med den till inte om har de var vi från men ska kan här där bilden visar texten bokstäver",
    "cs": "a v na s z do od pro po při o nebo ale není je jsou byl byla se to ten ta tato který která jak když kde už jen také velmi zde písmena obrázek ukazuje text",
    "tr": "bir ve bu da de için ile çok daha ama değil olarak gibi kadar sonra önce burada harfler görsel metin gösteriyor",
    "vi": "là và của các những một không có cho với này đó thì hơi rất còn kiểu chữ phần nét được để trong trên hợp đây dấu hình ảnh văn bản",
}
_WORDS = {lang: frozenset(w for w in text.split() if len(w) > 1) for lang, text in FREQUENT.items()}
# Letters that of these languages only the one has.
OWN_LETTERS = {"de": "ßäöü", "fr": "çœèêëîïûùàâ", "es": "ñ¿¡", "pl": "ąęłśźżńć", "pt": "ãõ", "cs": "řěůčš", "tr": "ğış", "sv": "å", "vi": "ơưđạảấầậểệịồộớờợụứựửữếềễốổỗẹẻẽọỏủũỳỷỹ"}
_OWN = {c: lang for lang, letters in OWN_LETTERS.items() for c in letters}
_QUOTED = re.compile(r"""„[^“”"]*[“”"]|“[^”]*”|«[^»]*»|「[^」]*」|"[^"]*"|‘[^’]*’""")
_SCRIPTS = (("ja", re.compile(r"[぀-ヿｦ-ﾟ]"), 1), ("ko", re.compile(r"[가-힣]"), 2), ("zh", re.compile(r"[㐀-鿿]"), 2), ("ru", re.compile(r"[Ѐ-ӿ]"), 3), ("el", re.compile(r"[Ͱ-Ͽ]"), 3), ("ar", re.compile(r"[؀-ۿ]"), 3), ("he", re.compile(r"[֐-׿]"), 3), ("th", re.compile(r"[฀-๿]"), 3), ("hi", re.compile(r"[ऀ-ॿ]"), 3))
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DANGLING = frozenset("and or the a an of in on to for with by at from as that which is are was than but yet so its their und oder der die das et ou le la les de du y o el los i w na z".split())
_ENDS = ".!?…。！？｡"


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit a token of ``a``."""
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        met = row & at.get(y, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


def shingles(tokens: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    width = min(width, len(tokens))
    return {tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)} if width else set()


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.replace("<|SEP|>", " ").replace("<|sep|>", " ").casefold())


def copies(answer: str, prompt: str) -> bool:
    """Whether the answer is made of the prompt: its shingles lie in it, or it follows it token by token."""
    said, asked = _tokens(ROLES.sub("", answer)), _tokens(prompt)
    if len(said) < SHINGLE or not asked:
        return False
    own, theirs = shingles(said), shingles(asked)
    if own and len(own & theirs) / len(own) >= CONTAINED:
        return True
    return lcs(said, asked) / len(said) >= COMMON


def language(text: str) -> str | None:
    """The language of a text, None if it can't be told. Two words or signs of it at least must speak for it."""
    for lang, letters, least in _SCRIPTS:
        if len(letters.findall(text)) >= least:
            return lang
    plain = re.sub(r"\w+(?:-\w+)+", " ", text.casefold().replace("’", "'"))  # compounds such as sans-serif belong to no language
    words = [w for w in _TOKEN.findall(plain) if not w.isdigit()]
    if len([w for w in words if len(w) > 1]) < 2:
        return None
    words = [p for w in words for p in ([w] if w in _WORDS["en"] else w.split("'")) if len(p) > 1]
    score = {lang: sum(w in known for w in words) for lang, known in _WORDS.items()}
    for c in text.casefold():
        if c in _OWN:
            score[_OWN[c]] += 1
    best = max(score, key=lambda x: (score[x], x == "en"))
    if best != "en" and score[best] <= score["en"]:
        best = "en"
    return best if score[best] >= 2 else by_grams(words)


@cache
def _profiles() -> dict[str, dict[str, float]]:
    """The log frequencies of each language's character pairs and triples, of its frequent words with their ends."""
    out = {}
    for lang, text in FREQUENT.items():
        grams = Counter(g for w in text.split() for g in _grams(w))
        total = sum(grams.values()) + 20_000
        out[lang] = {g: math.log((n + 1) / total) for g, n in grams.items()} | {"": math.log(1 / total)}
    return out


def _grams(word: str) -> list[str]:
    framed = f" {word} "
    return [framed[k : k + n] for n in (2, 3) for k in range(len(framed) - n + 1)]


def by_grams(words: list[str]) -> str | None:
    """The language whose character pairs and triples the words are most like, by ``MARGIN`` a word at least before the next; None for few words."""
    if len(words) < GRAM_WORDS:
        return None
    score = {lang: sum(profile.get(g, profile[""]) for w in words for g in _grams(w)) / len(words) for lang, profile in _profiles().items()}
    first, second = sorted(score, key=score.__getitem__)[:-3:-1]
    return first if score[first] - score[second] >= MARGIN else None


def foreign(answer: str, prompt: str) -> bool:
    """Whether a sentence of the answer, quoted text aside, is in another language than the prompt."""
    home = language(prompt) or "en"
    for sentence in re.split(r"(?<=[.!?。！？:：])\s*|\n+", _QUOTED.sub(" ", answer)):
        found = language(sentence)
        if found and found != home and {found, home} != {"ja", "zh"}:
            return True
    return False


def unfinished(answer: str) -> bool:
    """Whether prose stops before its end. Lists and a bare value end without a stop."""
    text = answer.rstrip()
    text = re.sub(r"[*_`\"'”’»)\]」]+$", "", text).rstrip() or text
    words = _tokens(text)
    if not words or text[-1] in _ENDS or not (text[-1].isalnum() or text[-1] in ",;:-–—(/&" or text[-1] in "%"):
        return False
    if words[-1] in _DANGLING:
        return True
    last = text.rsplit("\n", 1)[-1]
    if re.match(r"\s*(?:[-*•]|\d+[.)])\s", last) and len(_tokens(last)) <= 5:
        return False
    if "\n" not in text and re.fullmatch(r"[^.:!?]{1,40}:\s*[^.:!?]{1,40}", text) and len(_tokens(text.split(":", 1)[1])) <= 3:
        return False
    return len(words) > 2


_READING = re.compile(r"\b(?:transcribe|read|which characters|what characters|what text|which text|ocr)\b", re.I)
_LETTER = re.compile(r"[^\W_]")
_FRAMES = re.compile(r"""["'`“”„«»‹›()\[\]{}<>|.…_*#~\s]*""")


def judge(prompt: str, words: str, paths: int, asked: int | None, cut: bool, label: str | None) -> str | None:
    """The defect of an answer that holds words. asked: characters to draw, None if nothing is to be drawn; cut: it ends
    while thinking. A drawing answer of words alone that is none of the others lacks its paths and is truncated; a reading
    that is none of the others is complete, right or wrong."""
    bare = lambda s: re.sub(r"\s+", "", s.replace("<|SEP|>", "")).casefold()
    reading = asked is None and bool(_READING.search(prompt))
    if asked is None and label and bare(words) == bare(label):
        return None
    if not paths:
        if not _LETTER.search(words) and (not reading or len(words) > 1 and _FRAMES.fullmatch(words)):
            return "empty"
        if words.strip(" \t\r\n\"'`.()[]{}<>").casefold() in NOTHING:
            return "empty"
        if refuses(words):
            return "refusal"
        if copies(words, prompt):
            return "copy"
    if foreign(words, prompt):
        return "language"
    if cut:
        return "truncated"
    if asked is not None:
        return "truncated" if paths < max(asked, 1) else None
    if reading:
        return None
    return "truncated" if unfinished(words) else None


_SHOWN = r"[\x{ad}\x{34f}\x{180e}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}]"
_WHOLE_PATH = r"""(?i)<path\b[^<>]*?\bd\s*=\s*("[^"<>]*"|'[^'<>]*')[^<>]*>"""


def defects(rows: DataFrame, sample: str = "sample_id", instruction: str = "instruction", predict: str = "predict", label: str | None = "label") -> DataFrame:
    """``(sample, defect)``: one row for each sample whose answer is defective.

    defect is ``empty``, ``truncated``, ``refusal``, ``copy`` or ``language``. Rows written again under a sample count
    once (should they differ, the first defect by name). A null instruction asks for nothing: its answer can be
    empty, refusing, foreign to English or unfinished. Null samples count as one sample.
    """
    text = F.regexp_replace(F.col(predict), _SHOWN, "")
    thought = F.regexp_replace(text, r"(?is)<think>.*?</think>", " ")
    cols = rows.select(
        F.col(sample).alias("sample"),
        F.coalesce(F.col(instruction), F.lit("")).alias("prompt"),
        (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
        F.col(predict).isNull().alias("missing"),
        F.coalesce(thought.rlike(r"(?i)<think>"), F.lit(False)).alias("cut"),
        F.regexp_replace(thought, r"(?is)<think>.*$", " ").alias("body"),
    )
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"(?s)<!--(.*?)(-->|$)", " $1 "), r"(?s)<[A-Za-z/?!][^<>]*(>|$)", " "), r"```[\w-]*", " ")
    begun = F.col("body").rlike(r"(?i)<path\b|<[a-z]*[^<>|]*$")
    cols = cols.select("sample", "prompt", "label", "missing", "cut", F.coalesce(begun, F.lit(False)).alias("begun"), F.regexp_count("body", F.lit(_WHOLE_PATH)).cast("int").alias("paths"), F.length(wanted_text(F.col("prompt"))).alias("asked"), F.regexp_replace(shown, r"(?U)^[\s<>]+|[\s<>]+$", "").alias("words"))
    speaks = ~F.col("missing") & (F.col("words") != "")
    silent = F.when(F.col("missing"), "empty").when(F.col("cut"), "truncated").when((F.col("paths") == 0) & ~F.col("begun"), "empty").when(F.col("paths") < F.coalesce("asked", F.lit(1)), "truncated")
    wordless = cols.filter(~speaks).select("sample", silent.alias("defect")).filter("defect IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sample_, *rest = (batch.column(k) for k in range(batch.num_columns))
            found = pa.array([judge(*row) for row in zip(*(c.to_pylist() for c in rest), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([sample_, found], names=["sample", "defect"])

    kind = dict(rows.dtypes)[sample]
    worded = cols.filter(speaks).select("sample", "prompt", "words", "paths", "asked", "cut", "label").mapInArrow(run, f"sample {kind}, defect string").filter("defect IS NOT NULL")
    return wordless.unionByName(worded).groupBy("sample").agg(F.min("defect").alias("defect")).withColumnRenamed("sample", sample)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/prediction.parquet").select("sample_id", "instruction", "predict", "label")
    return defects(rows)


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
