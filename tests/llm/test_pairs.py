"""Defective responses: one case per kind and its near misses."""

from __future__ import annotations

import random
import time
from itertools import accumulate

import pytest

from millrace.llm.pairs import _near, defect, defects, is_copy, within

PROMPT = "Merge the change below into lib/tase.c and hand back the finished function. Do not touch anything else."
PATCH = "@@ -1,4 +1,4 @@\n static int f(int a)\n {\n-\treturn a;\n+\treturn a + 1;\n }\n"
CODE = "static int f(int a)\n{\n\tlock_it(a);\n\treturn a;\n}\n"
FIXED = CODE.replace("return a;", "return a + 1;")
TAGGED = f"<|patched_code|>\n{FIXED}<|/patched_code|>"

KINDS = {
    None: [TAGGED, f"I kept the new name.\n\n```c\n{FIXED}```", FIXED, "Nothing else in the function needed a change.", f"I can't see the rest of the file.\n\n{TAGGED}", f"{TAGGED}<|eot|>\n", f"The hunk was already there.\n\n```c\n{CODE}```", f"{PROMPT}\n\nThe new check sits in front of g().\n\n{TAGGED}"],
    "empty": [None, "", " \n", "​", "...", "(none)", "N/A", "```\n```", "```c\n\n```", "<|patched_code|>\n \n<|/patched_code|>", "{patched_code}\nnull\n{/patched_code}", "**--**"],
    "truncated": [f"<|patched_code|>\n{FIXED[:40]}", f"```c\n{FIXED}", f"I kept the new name.\n\n{TAGGED[:-6]}", "I kept the new name and", FIXED[:-2], "```c\n" + FIXED[:40]],
    "refusal": ["I'm sorry, but I can't help with this merge.", "Ich muss diese Anfrage ablehnen.", "{patched_code}\nLo siento, no voy a escribir este código.\n{/patched_code}", "抱歉，我无法协助这次合并。", "この依頼はお受けできません。", "Вынужден отклонить этот запрос.", "Je n'écrirai pas ce code.", "Não posso ajudar com esta mesclagem."],
    "copy": [PROMPT, PROMPT.upper(), f'"{PROMPT}"', "Q: " + PROMPT, PROMPT.replace("finished", "finshed"), PATCH, CODE, f"```c\n{CODE}```", f"<|patched_code|>\n{PATCH}<|/patched_code|>", f"{PROMPT}\n\n{PATCH}\n{CODE}"],
    "language": [f"Ich habe den neuen Namen behalten und den Aufruf nach unten verschoben.\n\n{TAGGED}", f"我保留了新名称，并把调用移到了下面。\n\n{TAGGED}", "Je ne peux pas voir le reste du fichier, seules les lignes indiquées changent donc."],
}


@pytest.mark.parametrize(("kind", "response"), [(k, r) for k, rs in KINDS.items() for r in rs])
def test_kinds(kind, response):
    assert defect(response, PROMPT, PATCH, CODE) == kind


def test_asked_language():
    german = f"Ich habe den neuen Namen behalten und den Aufruf nach unten verschoben.\n\n{TAGGED}"
    assert defect(german, PROMPT + " Write your explanation in German.", PATCH, CODE) is None
    assert defect(f"I kept the renamed variable and moved the call below it.\n\n{TAGGED}", PROMPT + " Write your explanation in German.", PATCH, CODE) == "language"


def test_rows(spark):
    responses = spark.createDataFrame([(1, 1, PROMPT, "x"), (2, 1, None, "x"), (2, 1, None, "x"), (3, 9, "I kept it and", "x"), (4, None, "n/a", "x"), (5, 1, TAGGED + " " * 500_000, "x")], "id long, req long, response string, defect string")
    requests = spark.createDataFrame([(1, PROMPT, PATCH, CODE), (2, None, None, None)], "req long, prompt string, patch string, code string")
    run = lambda a, b: sorted(tuple(r) for r in defects(a, b, "id", "req", "response", "prompt", "patch", "code").collect())
    assert run(responses, requests) == [(1, "copy"), (2, "empty"), (2, "empty"), (3, "truncated"), (4, "empty")]
    assert run(responses.limit(0), requests) == [] and run(responses.where("id = 3"), requests.limit(0)) == [(3, "truncated")]


@pytest.mark.parametrize("size", [1_000, 200_000, 259_000, 266_000, 1_000_000, 10_000_000])
def test_copies_of_every_size(size):
    rng = random.Random(size)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(size // 8))
    code = "\n".join(f"\tx = call_{rng.randrange(10**6)}(a);" for _ in range(size // 24))
    assert is_copy(text, text, "p" * 30, code) and is_copy(code, text, PATCH, code)
    assert is_copy(text[:500] + "#" + text[501:], text, PATCH, code)
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(size // 8))
    assert not is_copy(other, text, PATCH, code)


def test_near_copies_of_long_prompts_are_told_fast():
    rng = random.Random(3)
    asked = "".join(rng.choice("abcdefghijklmnop") for _ in range(170_000))
    near = list(asked)
    for at in rng.sample(range(len(near)), 30):
        near[at] = "z"
    began = time.process_time()
    assert _near("".join(near), asked) and _near("label" + "".join(near), asked)
    assert not _near(asked[::-1], asked) and not _near("".join(near[::2]) * 2, asked)
    assert time.process_time() - began < 1


def test_bounded_distance_is_that_of_the_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(accumulate(range(1, len(b) + 1), lambda left, j, x=x, row=row: row[j - 1] + 1 if x == b[j - 1] else max(left, row[j]), initial=0))
        for most in range(12):
            assert within(a, b, most) == (len(a) + len(b) - 2 * row[-1] <= most)


def test_short_code_is_copied_whole_only():
    assert is_copy("x = 1;", PROMPT, PATCH, "x = 1;") and not is_copy("x = 1; y = 22; z = 333; w = 4444; v = 55555;", PROMPT, PATCH, "x = 1;")


# Phrases written for this test alone; none is in the given tables.
DECLINED = [
    "Sorry, I am not able to do this merge for you.", "I won't be able to help with that request.", "This is a request I have to decline.", "Unfortunately I cannot assist you here, as it breaks the rules I follow.", "I would rather not touch this file.",
    "Leider kann ich Ihnen bei dieser Zusammenführung nicht helfen.", "Das darf ich nicht bearbeiten.", "Diese Bitte muss ich leider ablehnen.", "Dabei werde ich nicht helfen.",
    "Désolé, je ne peux pas vous aider pour cette fusion.", "Je refuse de modifier ce fichier.", "Je ne vais pas faire cette modification.",
    "Lo siento, no puedo ayudarte con esta fusión.", "Me niego a tocar este archivo.", "No voy a hacer este cambio.",
    "Desculpe, não posso ajudar com essa alteração.", "Recuso este pedido.", "Não vou fazer essa mudança.",
    "Извините, я не могу помочь с этим слиянием.", "Я отказываюсь менять этот файл.", "Я не буду делать это слияние.",
    "对不起，我不能帮你完成这个合并。", "我拒绝修改这个文件。", "很抱歉，我无法提供这段代码。",
    "申し訳ありませんが、このマージには対応できません。", "この変更はお断りします。", "このファイルの編集は引き受けられません。",
]
DONE = [
    "I could not find the second hunk, so only the first one is applied.", "The lock cannot be held here.", "The old name is not used any more.", "The function must not sleep, which is why the call moved.", "I did not change the comment.",
    "Die Funktion kann hier nicht schlafen.", "Der Rest bleibt unverändert.", "Ich habe die zweite Zeile nicht geändert.",
    "La fonction ne peut pas dormir ici.", "Je n'ai pas changé le commentaire.", "El nombre antiguo ya no se usa.", "No cambié el comentario.", "A função não pode dormir aqui.", "Não alterei o comentário.",
    "Функция не может спать здесь.", "Я не менял комментарий.", "这个函数不能休眠。", "我没有改动注释。", "この関数は眠れません。", "コメントは変更していません。",
]


def test_refusals_in_words_of_no_table():
    told = [x for x in DECLINED if defect(x, PROMPT, PATCH, CODE) == "refusal"]
    wrong = [x for x in DONE if defect(x, PROMPT, PATCH, CODE) == "refusal"]
    assert len(told) >= 0.9 * len(DECLINED), set(DECLINED) - set(told)
    assert not wrong
