"""Broken prompt and response pairs: empty, truncated, refused, copied, or answered in another language.

A response is joined with the request it answers and judged by itself, in this order:

* ``empty``: nothing is left without markers, fences, marks and invisible characters, or only a word for no value.
* ``copy``: the response is compressed with its prompt, patch and code as the zstandard dictionary, with window and match
  table as large as dictionary and response. If next to nothing is new, its letters and digits are compared with theirs:
  the code and the patch must be there unchanged, the prompt give or take a few characters (by an edit distance that
  stops at its bound), and nothing else but a label.
* ``refusal``: there is no code, and the prose says no by the refusal dictionary of its language.
* ``truncated``: a fence, tag or function is open at the end, or the prose ends in a context in which responses do not
  end, by a model of terminal contexts (last word and last sign) counted over all responses before
  (:func:`terminal_contexts`).
* ``language``: the prose is told by scripts and function words, and must be in the language that the prompt asks for,
  else in the prompt's own.

Texts are shuffled once, in the join by request. Every batch is judged row by row in Arrow batches with the dictionaries below.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import materialize

# Words for no value.
NO_VALUE = set(
    "none null nil na nan undefined empty blank void nothing tbd todo noanswer nooutput noresponse noresult nocontent notapplicable notavailable placeholder missing unknown "
    "keine keiner nichts leer aucun aucune vide rien ninguno ninguna nada vacío vacio vazio nenhum nenhuma нет пусто ничего 无 空 なし 没有 無".split()
)
MARKER = re.compile(r"[<{\[]{1,2}\|?\s*(/?)\s*([A-Za-z]+(?:_[A-Za-z]+)*)\s*/?\|?[>}\]]{1,2}")
BLOCK_NAMES = {"patched_code", "code", "answer", "result", "output", "response", "solution", "resolved", "patch"}
FENCE = re.compile(r"^[ \t]*(```+|~~~+)[ \t]*([\w+#.\-]*)[ \t]*\r?$", re.M)
FILLERS = str.maketrans("", "", "\u3164\u1160\uffa0")
WORDS = re.compile(r"[^\W_]+")
LABEL_MOST = 16
#: How many characters of a copied prompt may differ: one in ``FEW_SHARE``, but at least and at most so many.
FEW, FEW_SHARE, FEW_MOST = 12, 25, 64

# Ways to decline, by language. Each asserts that the task itself is not done.
REFUSAL = re.compile(
    "|".join(
        [
            # English
            r"\b(?:can(?:no|')?t|can not|won't|will not|unable to|not able to|not going to|must not|couldn't|refuse to|decline to)\s+(?:\w+\s+){0,2}?(?:help|assist|produce|write|comply|fulfil\w*|do (?:this|that|so)|merge|provide|continue|complete|create|generate|take (?:this|that|it) on|answer|carry out|make (?:this|that|these)|support|process|edit|modify|apply|resolve)\b(?! (?:this|it) here)",
            r"\b(?:have|has|had|must|need|forced|obliged) to (?:decline|refuse|pass)\b|\bI (?:must |respectfully |have |will )?(?:decline|refuse)\b|\bmust decline\b|\bdeclin(?:e|ing) (?:this|the|your)",
            r"\bnot something I (?:am|'m) (?:able|willing|allowed)|\bnot (?:allowed|permitted|willing|comfortable|authori[sz]ed) to\b|\b(?:request|answer)\b.{0,20}\bis no\b|\brule(?:s)? this out\b|\brather (?:not|leave)\b|\bhas to happen without me\b|\bI don't (?:take on|do|guess|write)\b|\btopic I stay away\b|\bstay away from\b|\bNo patched code from me\b|\bfalls? outside what I\b|\bagainst (?:my|the) (?:rules|policy|guidelines|terms)\b|\bdo not have the (?:rights?|permissions?)\b|\bdon't have (?:the )?(?:rights?|permissions?)\b|\bno view of\b|\bmay be misused\b|\bnot be (?:doing|writing|producing)\b|\bcount me out\b|\bleave (?:this|it|that) to\b|\bbeyond what I (?:can|may|am)\b|\bwould be a guess\b",
            # German
            r"\b(?:ablehnen|lehne\b.{0,40}\bab\b|verweigere|weigere mich)\b|\b(?:kann|darf|werde|will|möchte)\b.{0,60}\bnicht (?:schreiben|helfen|bearbeiten|erledigen|übernehmen|ändern|ausführen|erstellen|liefern|anfassen|vornehmen|mergen|zusammenführen|weiterhelfen|dienen)|\b(?:übernehme|mache|schreibe|erledige) (?:ich )?(?:das )?(?:ich )?nicht\b|\blasse ich (?:lieber )?die Finger\b|\bnicht (?:erlaubt|gestattet|zulässig)\b|\bohne mich\b|\bfehlt der Überblick\b|\bkeine? (?:Rechte|Berechtigung|Erlaubnis)\b|\bgeht über das hinaus\b|\bnicht behilflich\b|\bbedauere\b|\blieber nicht\b",
            # French
            r"\b(?:refuse|décline|décliner|refuser)\b|\bn'écrirai pas\b|\bne (?:peux|puis|veux|vais|souhaite|pourrai) pas (?:vous |t'|l'|le |la |y )?(?:aider|écrire|faire|traiter|répondre|produire|fournir|effectuer|modifier|donner|réaliser|toucher|accepter|prendre|fusionner|m'en charger)|\bn'ai pas le droit\b|\bpas (?:autorisé|permis)\b|\bsort de ce qui\b|\btel quel, faites-le\b|\bpréfère ne pas\b|\bne m'en (?:charge|occupe)\w* pas\b|\bsans moi\b|\bne (?:touche|toucherai)\w* pas à\b|\bdépasse ce que\b|\bpeut(?:-| )être détourné",
            # Spanish
            r"\b(?:rechazar|rechazo|declinar|declino|negarme|me niego)\b|\bno (?:puedo|podré|voy a|quiero|pienso|debo) (?:ayudar\w*|escribir|hacer\w*|atender|cumplir|realizar|producir|proporcionar|modificar|tocar|encargarme|aceptar|fusionar|generar)|\bno tengo permiso\b|\bqueda fuera de lo que\b|\bprefiero no\b|\bno me encargo\b|\bno me está permitido\b|\bsin mí\b|\bno est(?:á|oy) (?:permitido|autorizad\w)",
            # Portuguese
            r"\b(?:recusar|recuso|recuso-me|declinar)\b|\bnão (?:posso|vou|quero|devo|poderei|consigo) (?:ajudar\w*|escrever|fazer|atender|cumprir|realizar|produzir|fornecer|alterar|modificar|mexer|aceitar|mesclar|gerar|tocar)|\bnão tenho permissão\b|\bestá fora do que\b|\bprefiro não\b|\bnão (?:me encarrego|trato disso|cuido disso|assumo)\b|\bsem mim\b|\bnão (?:me é|é|estou) (?:permitido|autorizad\w)",
            # Russian
            r"\b(?:отклонить|отклоняю|отказаться|отказываюсь|откажусь|вынужден\w* отказать\w*)\b|\bне (?:буду|стану|могу|смогу|хочу|возьмусь)\b.{0,40}\b(?:писать|помоч\w*|помогать|выполн\w*|сдела\w*|делать|менять|трогать|измен\w*|слива\w*|брат\w*|взят\w*)|\b(?:писать|трогать|менять|делать|помогать|помочь)\b.{0,30}\bне (?:буду|стану|могу|смогу)\b|\bне разрешено\b|\bнет (?:права|прав|доступа|разрешения)\b|\bвыходит за рамки\b|\bне возьмусь\b|\bбез меня\b|\bлучше не (?:трогать|буду)\b|\bне берусь\b",
            # Chinese
            r"无法协助|不能协助|无法帮助|不能帮|无法提供|不能提供|拒绝|不能编写|无法编写|不会编写|不能写|无法完成|不能完成|无权|没有.{0,30}权限|超出了?.{0,6}范围|还是不碰|恕难|不便|无能为力|不予|不被允许|不允许我|爱莫能助|不接受这|我不会(?:写|做|修改|处理|改)|我不(?:做|写|处理|接)",
            # Japanese
            r"お受けできません|お手伝いできません|お断り|ご辞退|辞退|手を出さない|できかねます|応じられません|対応できません|対応いたしかね|書くことはできません|書けません|許可されていません|許可された範囲を超え|権限がありません|控えさせて|遠慮|承れません|引き受け(?:られ|でき)ません|協力できません|作成できません|いたしません|拒否|触れない(?:こと|で)",
        ]
    ),
    re.I,
)

# Function words, by language.
FUNCTION = {
    "en": "the and of to is was were in it its that this not with for as on by be are have has had you your i now here from which so but can any no he she they we be below above stays stayed more",
    "de": "der die das und ist nicht mit ich hat haben den dem ein eine von zu auf nun hier da wie es war wird nur sonst beide beiden leider steht daher deshalb bitte im am zum zur für über unter vor nach auch noch den sich nichts danach ohne sehr wenn dass kurz",
    "fr": "le la les des et est pas pour je ne que qui dans un une du sur ce cette comme avec au aux nous reste avant désolé l'appel il fallait en tu vous donc par plus de c'est j'ai n'avait d'erreur après sans aussi très quand où rien dehors ensuite",
    "es": "el la los las y es no se que del un una por con para como he queda lo al aquí más ahora antes resto pide siento hacía así ambos gana de en su sigue no archivo está son hay qué has ha después nada fuera sin sobre también muy otro otra esta esto cuando donde primeras están brevemente",
    "pt": "o os as e não se que do da dos um uma por com para como ao aqui mais agora antes resto pede desculpe foi preciso dois vence de em isso mantive passei pode no na nos nas você está são há depois também muito outro outra esta isto quando onde fora nada sem sobre primeiras estão",
    "ru": "и в не на что как так это здесь был было с по для к из за я он она они мы то от же уже теперь перед того путь более",
}
VOTES: dict[str, list[str]] = {}
for _lang, _words in FUNCTION.items():
    for _w in set(_words.split()):
        VOTES.setdefault(_w, []).append(_lang)
HINTS = [
    ("es", re.compile(r"[ñ¿¡]|ción\b|\w[áéíóú]n\b")),
    ("pt", re.compile(r"[ãõ]|ção\b|\bções")),
    ("fr", re.compile(r"[èêûîœù]|\b[jldnsc]['’][^\W\d_]|\bqu['’][^\W\d_]")),
    ("de", re.compile(r"[äöüß]")),
]

# Names of languages in the languages of prompts.
NAMES = {
    "en": "english englisch anglais inglés inglês по-английски английск 英文 英语 英語",
    "de": "german deutsch allemand alemán alemão по-немецки немецк 德文 德语 ドイツ語",
    "fr": "french französisch français francés francês по-французски французск 法文 法语 フランス語",
    "es": "spanish spanisch espagnol español espanhol по-испански испанск 西班牙文 西班牙语 スペイン語",
    "pt": "portuguese portugiesisch portugais portugués português по-португальски португальск 葡萄牙文 葡萄牙语 ポルトガル語",
    "ru": "russian russisch russe ruso russo по-русски русск 俄文 俄语 ロシア語",
    "zh": "chinese chinesisch chinois chino chinês по-китайски китайск 中文 汉语 中国語",
    "ja": "japanese japanisch japonais japonés japonês по-японски японск 日文 日语 日本語",
}
NAME_OF = {name: lang for lang, names in NAMES.items() for name in names.split()}
WIDE_NAMES = [(name, lang) for name, lang in NAME_OF.items() if name[0] > "⺀"]
TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
KANA, HAN, CYRILLIC, LATIN = (re.compile(x) for x in ("[぀-ヿ]", "[㐀-鿿]", "[Ѐ-ӿ]", "[A-Za-zÀ-ɏ]"))
SPOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
TWO_LETTERS = re.compile(r"[^\W\d_]{2}")
PARTIAL_END = re.compile(r"[<{\[]{1,2}\|?/?[a-z_]*\|?$|(?:^|\n)[ \t]*`{1,2}$")
SPACES = re.compile(r"\s+")
IDENTIFIER = re.compile(r"https?:[!-~]+|`[^`]*`|[A-Za-z0-9_.\-]*[_/][A-Za-z0-9_./\-]*[A-Za-z0-9_](?:\(\))?|[A-Za-z0-9_]+\(\)")

CODE_LINE = re.compile(r"^(?:[ \t]*(?:static|struct|if \(|if\(|for \(|switch \(|int |u\d\d |return\b|goto |[{}]|/\*|\*/|#include|#define|//|break;|else\b|case )|\t+\S|[+\-@ ]?\t)|[;{}]\s*(?:/\*.*\*/)?\s*$|^[ \t]*\w+\([^)]*\);?\s*$")
CLOSING = "'\"”’»“」』)]）】*_~`​﻿ \t\r"
# Marks that end a sentence: the prior of the model of terminal contexts.
FINAL_MARKS = ".!?…。！？।؟:："
#: Weights of the priors of signs and words in observations, the ratio below which a context is no place to end, characters
#: of prose that a response must have to count as an end (shorter ones are often no answers), and of a word with a context.
PRIOR_WEIGHT, WORD_WEIGHT, LEAST_RATIO, LEAST_PROSE, LONGEST_WORD = 2000.0, 50.0, 0.5, 40, 24
#: The least share of all ends that a last word has to be told from its sign.
LEAST_ENDS = 1e-4
LAST_WORD = regex.compile(r"(?:[\p{Han}\p{Hiragana}\p{Katakana}]|[^\s\p{Han}\p{Hiragana}\p{Katakana}]+)$")
LONGEST_NO_VALUE = max(map(len, NO_VALUE))
#: Code or patch of fewer visible characters is a copy only if it is the whole response.
SHORT = 20


def language(text: str) -> str | None:
    """The language of prose, or None if there is too little to tell."""
    text = IDENTIFIER.sub(" ", text)
    if not text.isascii():
        kana, han, cyrillic, latin = (len(x.findall(text)) for x in (KANA, HAN, CYRILLIC, LATIN))
        if (kana + han) * 3 >= max(latin, cyrillic) and kana + han >= 2:
            return "ja" if kana * 8 >= han else "zh"
        if cyrillic > latin and cyrillic >= 4:
            return "ru"
    text = text.lower()
    score: Counter[str] = Counter()
    for w in SPOKEN.findall(text):
        for lang in VOTES.get(w, ()):
            score[lang] += 1 / len(VOTES[w])
    for lang, hint in HINTS:
        score[lang] += 0.7 * min(4, len(hint.findall(text)))
    (best, top), (_, second) = (score.most_common(2) + [("", 0.0), ("", 0.0)])[:2]
    return best if top >= 1 and top > 1.15 * second else None


@lru_cache(maxsize=1024)
def wanted(prompt: str) -> str | None:
    """The language that a prompt asks for, or else is written in."""
    plain = IDENTIFIER.sub(" ", prompt.lower())
    asked = [lang for w in TOKEN.findall(plain) for lang in (NAME_OF.get(w) or NAME_OF.get(w[:-1]) or NAME_OF.get(w[:-2]) or NAME_OF.get(w[:-3]),) if lang]
    asked += [lang for name, lang in WIDE_NAMES if name in plain]
    return asked[-1] if asked else language(prompt)


def letters(text: str) -> str:
    return "".join(WORDS.findall(text)).lower()


def squashed(text: str) -> str:
    """Without white space, and without the signs of quoted lines if all lines have them."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if lines and all(x.startswith(">") for x in lines):
        lines = [x[1:] for x in lines]
    return "".join("".join(lines).split())


class Parts:
    """A response in parts: prose outside of blocks, the blocks' contents, and what is open at the end."""

    def __init__(self, text: str) -> None:
        self.text = text
        tokens = [(m.start(), m.end(), "tag", m[1] == "/") for m in MARKER.finditer(text) if m[2].lower() in BLOCK_NAMES]
        other = [(m.start(), m.end(), "gone", False) for m in MARKER.finditer(text) if m[2].lower() not in BLOCK_NAMES and "|" in m[0]]
        tokens += other + [(m.start(), m.end(), "fence", False) for m in FENCE.finditer(text)]
        tokens.sort()
        prose, blocks, at, tag, fence = [], [], 0, False, False
        for a, b, kind, close in tokens:
            if a < at:
                continue
            (blocks if tag or fence else prose).append(text[at:a])
            at = b
            if kind == "fence":
                fence = not fence
            elif kind == "tag":
                tag = not close
        (blocks if tag or fence else prose).append(text[at:])
        self.open = tag or fence
        self.last_is_block = bool(tokens) and not text[at:].strip()
        code_lines, prose_lines = [], []
        for piece in prose:
            lines = [x for x in piece.splitlines() if x.strip()]
            coded = [bool(CODE_LINE.search(x)) for x in lines]
            for x, c in zip(lines, coded, strict=True):
                (code_lines if c else prose_lines).append(x)
        self.bare = code_lines
        self.blocks = [b for b in blocks if b.strip()]
        self.prose = "\n".join(prose_lines)
        self.content = "\n".join([*prose, *blocks])

    def has_code(self, least: int = 2) -> bool:
        """At least so many lines of code."""
        n = len(self.bare)
        for b in self.blocks:
            for x in b.splitlines():
                n += bool(x.strip() and CODE_LINE.search(x))
                if n >= least:
                    return True
        return n >= least

    def block_prose(self) -> list[str]:
        return [x for b in self.blocks for x in b.splitlines() if not CODE_LINE.search(x) and TWO_LETTERS.search(x)]


def own_prose(prose: str, prompt: str) -> str:
    """The prose without the lines that repeat the prompt."""
    return "\n".join(x for x in prose.splitlines() if x.strip() not in prompt)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    bare = ""
    for m in WORDS.finditer(FENCE.sub(" ", MARKER.sub(" ", text))):
        bare += m[0].lower().translate(FILLERS)
        if len(bare) > LONGEST_NO_VALUE:
            return False
    return not bare or bare in NO_VALUE


def _same_run(a: str, b: str, x: int, y: int) -> int:
    """How many characters of ``a`` from ``x`` on equal those of ``b`` from ``y`` on."""
    start, n = x, 16
    while n and x < len(a) and y < len(b):
        m = min(n, len(a) - x, len(b) - y)
        if a[x : x + m] == b[y : y + m]:
            x, y, n = x + m, y + m, n * 2
        elif m == 1:
            break
        else:
            n = m // 2
    return x - start


def within(a: str, b: str, most: int) -> bool:
    """``b`` comes from ``a`` by at most ``most`` insertions and deletions of a character; the work grows with most * most."""
    if abs(len(a) - len(b)) > most:
        return False
    reach = {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or k != d and reach[k - 1] < reach[k + 1] else reach[k - 1] + 1
            y = x - k
            if x <= len(a) and 0 <= y <= len(b):
                x += _same_run(a, b, x, y)
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                return True
    return False


def _near(a: str, b: str) -> bool:
    """Equal up to a few characters: so many at most of the longer one have no match in the other."""
    few = max(FEW, min(len(b) // FEW_SHARE, FEW_MOST))
    return a == b or bool(b) and within(a, b, 2 * few - abs(len(a) - len(b)))


def _new_bytes(text: bytes, source: bytes) -> int:
    """The size of ``text`` compressed with ``source`` as the dictionary; window and match table hold both, at any size."""
    log = (len(source) + len(text)).bit_length()
    params = zstandard.ZstdCompressionParameters.from_level(1, window_log=min(max(log + 1, 12), 27), hash_log=min(max(log, 12), 26), write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(source, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(text))


def is_copy(content: str, prompt: str, patch: str, code: str) -> bool:
    """Only what the request holds: prompt, patch or code, or several of them."""
    text = content.strip()
    if not text:
        return False
    source = "\n".join((prompt, patch, code)).encode()
    if len(source) < 16:
        return letters(content) == letters(prompt) != ""
    new = _new_bytes(text.encode(), source)
    if text.isupper():
        new = min(new, _new_bytes(text.lower().encode(), prompt.lower().encode() + b"\n" * 16))
    if new > 48 + len(text.encode()) // 8:
        return False
    rest, found = squashed(content), False
    for piece in (squashed(code), squashed(patch)):
        if len(piece) >= SHORT and piece in rest or piece and piece == rest:
            rest, found = rest.replace(piece, " ", 1), True
    rest = letters(rest)
    asked = letters(prompt)
    if found and len(rest) <= LABEL_MOST:
        return True
    if not asked or len(rest) < 6:
        return False
    if asked in rest and len(rest) - len(asked) <= LABEL_MOST:
        return True
    return any(_near(rest[n:], asked) for n in range(LABEL_MOST + 1))


@dataclass(frozen=True)
class Contexts:
    """How much more often responses end in a context than words within them do: by last sign, and for last words the factor
    by which they differ from their sign."""

    signs: dict[str, float] = field(default_factory=dict)
    words: dict[tuple[str, str], float] = field(default_factory=dict)


def terminal_contexts(responses: DataFrame, response: str) -> Contexts:
    """The model of terminal contexts, counted over all rows in one scan.

    The context of a place is its last sign (all letters are one sign L, all digits N) and its last word. Words are told
    from their sign only if they end a response in at least ``LEAST_ENDS`` of all ends, so at most 1 / ``LEAST_ENDS``
    words and one number for each sign that ends a response come to the driver.
    """
    outside = F.regexp_replace(response, r"(?s)```.*?(?:```|\z)|[<{]{1,2}\|?patched_code.*?(?:/patched_code\|?[>}]{1,2}|\z)|<\|\w+\|>", "\n")
    prose = F.regexp_replace(outside, r"(?m)^.*[;{}]\s*$|^[\t+\-@ ].*$|\(\)", "")
    wide = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
    closers = r"['\"”’»“」』)\]）】*_~`]"
    last = F.regexp_extract(F.regexp_replace(F.rtrim(F.regexp_replace(prose, r"\s+\z", "")), rf"{closers}++\z", ""), rf"([{wide}]|(?<![^\s{wide}])[^\s{wide}]++)\z", 1)
    tail = F.when(F.length(F.btrim(prose)) < LEAST_PROSE, "").otherwise(last)
    inner = F.regexp_extract_all(prose, F.lit(rf"(?<![^\s{wide}])[^\s{wide}]++(?=\s++\S)|[{wide}](?=\S)"), F.lit(0))
    place = lambda w, end: F.struct(F.lower(w).alias("w"), F.lit(end).alias("end"))
    both = responses.where(F.col(response).isNotNull()).select(F.explode(F.concat(F.array(place(tail, 1)), F.transform(inner, lambda w: place(w, 0)))).alias("x"))
    sign = F.regexp_replace(F.regexp_replace(F.right("x.w", F.lit(1)), r"\p{L}", "L"), r"\p{N}", "N")
    word = F.when(F.length("x.w") <= LONGEST_WORD, F.col("x.w")).otherwise("")
    counts = materialize(both.where("x.w <> ''").groupBy(sign.alias("c"), word.alias("w")).agg(F.sum("x.end").alias("ends"), F.sum(1 - F.col("x.end")).alias("inner")), "contexts")
    signs = {r["c"]: (r["ends"], r["inner"]) for r in counts.groupBy("c").agg(F.sum("ends").alias("ends"), F.sum("inner").alias("inner")).where("ends > 0 or inner > 0").collect()}
    ends, inner = (sum(x[i] for x in signs.values()) for i in (0, 1))
    often = counts.where((F.col("ends") > 0) & (F.col("ends") >= LEAST_ENDS * ends)).collect()
    expected = lambda r: r["inner"] * signs[r["c"]][0] / max(1, signs[r["c"]][1])
    words = {(r["c"], r["w"]): (r["ends"] + WORD_WEIGHT) / (expected(r) + WORD_WEIGHT) for r in often}
    return Contexts({c: _ratio(c, e, i, ends, inner) for c, (e, i) in signs.items() if e}, words)


def _ratio(c: str, ends: int, inner: int, all_ends: int, all_inner: int) -> float:
    """(share of ends with ``c``) / (share of inner words with ``c``), drawn towards what is usual for marks and letters."""
    p, q = (0.05, 0.005) if c in FINAL_MARKS else (0.0005, 0.01)
    return ((ends + PRIOR_WEIGHT * p) / (all_ends + PRIOR_WEIGHT)) / ((inner + PRIOR_WEIGHT * q) / (all_inner + PRIOR_WEIGHT))


def may_end(line: str, contexts: Contexts) -> bool:
    """Prose that ends with ``line`` may be whole."""
    line = line.replace("()", "").rstrip()
    last = LAST_WORD.search(line.rstrip(CLOSING) or line[-1:])
    word = last[0].lower() if last else ""
    sign = "L" if word[-1:].isalpha() else "N" if word[-1:].isnumeric() else word[-1:]
    return contexts.signs.get(sign, _ratio(sign, 0, 0, 0, 0)) * contexts.words.get((sign, word), 1.0) >= LEAST_RATIO


def is_truncated(parts: Parts, code: str, contexts: Contexts) -> bool:
    """The terminal context is not one in which a response ends."""
    if parts.open:
        return True
    tail = MARKER.sub("", parts.text).rstrip() if not parts.last_is_block else ""
    if not parts.last_is_block and PARTIAL_END.search(parts.text.rstrip()[-40:]):
        return True
    last = [x for x in tail.splitlines() if x.strip()][-1:]
    if last and not CODE_LINE.search(last[0]):
        return not may_end(last[0], contexts)
    body = [x for b in parts.blocks for x in b.splitlines() if x.strip()] or parts.bare
    if not body or not parts.has_code(1):
        return False
    whole = [x for x in code.splitlines() if x.strip()]
    return bool(whole) and whole[-1].strip() == "}" and body[-1].strip() != "}" and body[-1].strip() not in {x.strip() for x in whole[-2:]}


def defect(response: str | None, prompt: str | None, patch: str | None, code: str | None, contexts: Contexts | None = None) -> str | None:
    """The kind of defect; without ``contexts`` the terminal contexts are those of the prior."""
    if is_empty(response):
        return "empty"
    prompt, patch, code = prompt or "", patch or "", code or ""
    parts = Parts(response)
    if is_copy(parts.content, prompt, patch, code):
        return "copy"
    if not parts.has_code():
        said = "\n".join([parts.prose, *parts.block_prose()])
        if REFUSAL.search(IDENTIFIER.sub("x", SPACES.sub(" ", said.replace("’", "'")))):
            return "refusal"
    if is_truncated(parts, code, contexts or Contexts()):
        return "truncated"
    spoken, asked = language(own_prose(parts.prose, prompt)), wanted(prompt)
    if spoken and asked and spoken != asked:
        return "language"
    return None


def _judge(contexts: Contexts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)
            kinds = pa.array([defect(*row, contexts) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kinds], ["i", "d"])

    return run


def defects(responses: DataFrame, requests: DataFrame, item: str, key: str, response: str, prompt: str, patch: str, code: str) -> DataFrame:
    """(``item``, ``defect``): one row per defective response.

    A response without request (or with a null ``key``) is judged by itself, as if prompt, patch and code were empty.
    ``key`` names one request. Repeated responses are judged one by one. Other columns are not read. Empty tables give
    no rows.
    """
    left = responses.select(F.col(item).alias("i"), F.col(key).alias("k"), F.col(response).alias("r"))
    right = requests.select(F.col(key).alias("k"), F.col(prompt).alias("p"), F.col(patch).alias("x"), F.col(code).alias("c"))
    kind = dict(left.dtypes)["i"]
    judged = left.join(right, "k", "left").select("i", "r", "p", "x", "c").mapInArrow(_judge(terminal_contexts(left, "r")), f"i {kind}, d string")
    return judged.where(F.col("d").isNotNull()).select(F.col("i").alias(item), F.col("d").alias("defect"))
