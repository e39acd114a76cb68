from precis.functions.text import (
    clean_text, strip_ws, section_of, sentence_array, token_array, remove_stop_words,
    english_stop_words, bigrams, unigrams_and_bigrams, summary_path, id_from_summary_name,
    record_key, task_prefix, truncate_words, generation_bounds, DEFAULT_SECTION_RULES,
)

__all__ = [
    "clean_text", "strip_ws", "section_of", "sentence_array", "token_array",
    "remove_stop_words", "english_stop_words", "bigrams", "unigrams_and_bigrams",
    "summary_path", "id_from_summary_name", "record_key", "task_prefix", "truncate_words",
    "generation_bounds", "DEFAULT_SECTION_RULES",
]
