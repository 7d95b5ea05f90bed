from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, window string, component long, score double, n string"


def documents(spark, rows):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, f"s{(i or 0) % 3}", None if t is None else len(t), 1, "r", "w", 5, 0.5, "n") for i, t in rows], SCHEMA)


LONG = " ".join(f"word{k % 977}x{k}" for k in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly watch from a tall green hill beside the old river bank near town"
HARD = [(1, None), (2, ""), (3, BASE), (4, BASE), (4, BASE), (5, BASE.upper()), (6, "one"), (7, LONG), (8, BASE.replace("river", "stream")), (9, "   \n\t"), (None, BASE), (10, "é\nÉ ñ 🙂\n" * 3)]
