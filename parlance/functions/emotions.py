"""Emotion words: hits by emotion, shares, and the dominant emotion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMOTIONS = ("anger", "fear", "joy", "surprise", "sadness", "disgust", "anticipation", "trust")
# The words of each emotion, by language.
LEXICON: dict[str, dict[str, tuple[str, ...]]] = {
    "he": {
        "anger": ("כועס", "זעם", "עצבני", "בושה", "תפסיק", "נורא", "תלונה", "מרגיז", "שקר", "עצבים"),
        "fear": ("מפחד", "פחד", "חרדה", "סכנה", "דאגה", "מלחיץ", "בהלה", "להילחץ", "נלחץ"),
        "joy": ("שמח", "מעולה", "כיף", "נהדר", "מצוין", "תודה", "ברכות", "יופי", "תענוג", "מעריכים"),
        "surprise": ("מופתע", "באמת", "לא ייאמן", "ואו", "וואו", "מה פתאום", "שוק", "פתאום"),
        "sadness": ("עצוב", "חבל", "מאכזב", "מסכן", "כואב", "צער", "בדידות", "אכזבה"),
        "disgust": ("מגעיל", "דוחה", "גרוע", "מזעזע", "איכס", "מחריד", "גועל"),
        "anticipation": ("מחכה", "מקווה", "מתי", "בקרוב", "מצפה", "תעדכן", "ממתין", "נמתין"),
        "trust": ("מסכים", "בטח", "סומך", "בסדר גמור", "אין בעיה", "כמובן", "מאמין", "מקובל", "הבנתי"),
    },
    "ru": {
        "anger": ("злой", "злость", "возмутительно", "кошмар", "безобразие", "ненавижу", "крик", "обман", "бесит"),
        "fear": ("страх", "боюсь", "тревога", "паника", "опасно", "испуг", "страшно", "переживаю"),
        "joy": ("спасибо", "отлично", "замечательно", "супер", "рад", "прекрасно", "молодец", "здорово", "благодарю"),
        "surprise": ("неужели", "серьезно", "вау", "ничего себе", "шок", "неожиданно"),
        "sadness": ("грустно", "жаль", "обидно", "печально", "разочарован", "тоска", "сочувствую"),
        "disgust": ("отвратительно", "мерзко", "ужасно", "фу", "гадость", "паршиво"),
        "anticipation": ("жду", "надеюсь", "когда", "скоро", "ожидаю", "рассчитываю"),
        "trust": ("согласен", "доверяю", "конечно", "без проблем", "договорились", "верю", "понял"),
    },
    "en": {
        "anger": ("angry", "furious", "outrageous", "unacceptable", "annoying", "hate", "mad"),
        "fear": ("afraid", "scared", "anxiety", "worried", "panic", "danger"),
        "joy": ("thank", "thanks", "great", "excellent", "wonderful", "happy", "amazing", "glad", "awesome"),
        "surprise": ("wow", "really", "unbelievable", "shocked", "unexpected"),
        "sadness": ("sad", "sorry", "disappointed", "unfortunate", "regret"),
        "disgust": ("disgusting", "awful", "terrible", "gross", "nasty"),
        "anticipation": ("waiting", "hoping", "expecting", "looking forward", "soon"),
        "trust": ("agree", "trust", "definitely", "absolutely", "confident", "sure", "understood"),
    },
}


def hits(text: Column, lang: Column, emotion: str) -> Column:
    """Words of ``emotion`` that occur somewhere in the text (each counts once); he and ru by one list, all else by all three."""
    low = F.lower(text)
    by = {code: sum((low.contains(w).cast("int") for w in words[emotion]), F.lit(0)) for code, words in LEXICON.items()}
    return F.when(lang == "he", by["he"]).when(lang == "ru", by["ru"]).otherwise(by["he"] + by["ru"] + by["en"])


def distribution(counts: dict[str, Column]) -> tuple[dict[str, Column], Column]:
    """Each emotion's share with ``neutral`` apart from them, and the first of the largest."""
    total = sum(counts.values(), F.lit(0))
    shares = {e: F.when(total > 0, c / total).otherwise(F.lit(0.0)) for e, c in counts.items()}
    neutral = F.when(total > 0, F.greatest(F.lit(0.0), 1 - F.least(total / 5, F.lit(1.0)))).otherwise(F.lit(1.0))
    every = {**shares, "neutral": neutral}
    best = F.greatest(*shares.values())
    dominant = F.when(total == 0, "neutral")
    for e, s in shares.items():
        dominant = dominant.when(s == best, e)
    return every, dominant
