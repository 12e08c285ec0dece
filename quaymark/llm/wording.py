"""Wording that refusals are told by."""

from __future__ import annotations

import regex

# Wording in which a speaker declines, and in which a speaker means itself, in the languages served.
DECLINES = regex.compile(
    r"\b(?:can(?:no|['’]?)t|could not|unable|not able|able to do|won['’]?t be able|decline|refuse|prefer not|pass on this|no opinion|no comment|not allowed|not (?:be )?appropriate|not feel comfortable|not something|against my guidelines|inappropriate)\b"
    r"|ne peux pas|ne puis|impossible|refuser|désolé|préfère ne pas|ablehnen|nicht beantworten|nicht helfen|kann ich (?:nicht|keine)|ich kann (?:nicht|keine)|darf ich|leider"
    r"|no puedo|no me es posible|prefiero no|lo siento|no podré|не могу|не смогу|отказаться|вынужден|извините|к сожалению|нельзя"
    r"|无法|不能|抱歉|对不起|拒绝|できません|お断り|申し訳|お答えでき|控え"
)
ITSELF = regex.compile(
    r"\b(?:i(?=\s+\p{L})|i['’](?:m|ll|ve|d)|i won['’]t|me|my|as an? (?:ai|assistant|language model))\b|\b(?:je|j['’]|m['’]est|moi|en tant que)\b|m['’]est|\b(?:ich|mir|als (?:ki|sprachmodell))\b"
    r"|\b(?:puedo|prefiero|me es|lo siento|como modelo|yo)\b|\b(?:я|мне|могу|как языковая модель|извините)\b|我|作为|言語モデル|できません|お断り|申し訳|私"
)

#: Words of these patterns; they are never taken for names.
WORDS = frozenset(regex.findall(r"\p{L}{3,}", DECLINES.pattern + " " + ITSELF.pattern)) | frozenset(
    w.replace("'", sign) for w in ("can't", "won't", "i'm", "i'll", "i've", "i'd", "j'ai", "m'est") for sign in "'’"
)
#: All words of these patterns; a text without any can't match them.
CUES = WORDS | frozenset(regex.findall(r"\p{L}+", DECLINES.pattern + " " + ITSELF.pattern))

#: Sentences that decline, to validate what refusals are told by.
SEEDS = {
    "en": ("i'm sorry, but i can't help with that.", "i am unable to answer this question.", "as an ai, i cannot do that."),
    "fr": ("désolé, je ne peux pas répondre à cette question.", "en tant que modèle, je ne peux pas vous aider."),
    "de": ("ich kann diese frage leider nicht beantworten.", "tut mir leid, ich kann dabei nicht helfen."),
    "es": ("lo siento, no puedo responder a esa pregunta.", "como modelo no puedo ayudar con eso."),
    "ru": ("извините, я не могу ответить на этот вопрос.", "к сожалению, я не могу помочь."),
    "zh": ("对不起，我无法回答这个问题。", "抱歉，我不能帮忙。"),
    "ja": ("申し訳ありませんが、その質問にはお答えできません。", "すみません、お手伝いできません。"),
}
