"""Stemmers against published examples, and analyzers of a corpus."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions.stemming import STEMMERS
from quillon.operators import search
from quillon.sources import files

WORDS = {
    "german": "aufeinander aufeinand kategorischen kategor kategorien kategori kätzchen katzch katers kat auffassungen auffass häuser haus kauften kauft keineswegs keinesweg möglichkeit moglich ergebnisse ergebnis straße strass",
    "spanish": "cheques chequ torneos torne torneo torne chilenos chilen tormentas torment torpedeado torped chocolate chocolat chicharrones chicharron tortilla tortill chica chic rápidamente rapid universidades univers nación nacion canciones cancion",
    "french": "continua continu continuation continu continué continu continuellement continuel majestueusement majestu mains main maintenait mainten maintenant mainten majestueux majestu maître maîtr malade malad malheureusement malheur contrainte contraint contre contr contribution contribu nationalité national quelques quelqu",
}


@pytest.mark.parametrize("name", WORDS)
def test_published_examples(name):
    words = WORDS[name].split()
    assert [STEMMERS[name](w) for w in words[::2]] == words[1::2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeilmnoqrstuyéèïüßçIq", max_size=14), st.sampled_from(sorted(STEMMERS)))
def test_any_word_has_a_stem(word, name):
    found = STEMMERS[name](word.lower())
    assert found == found.lower() and len(found) <= len(word) + word.count("ß") + 1


def test_language_of_a_corpus(spark):
    corpus = files.from_literal(spark, "# Eins\n\nviele Häuser und Gärten\n_\n# Zwei\n\nein Haus und ein Hund\n_\n# Drei\n\nund nichts\n")
    corpus.options |= {"language": "german", "stop_words": ("und", "ein")}
    assert sorted(r["key"] for r in search.bm25(corpus, "Hauses").collect()) == ["1", "2"]
    assert search.bm25(corpus, "und ein").count() == 0
    with pytest.raises(ValueError):
        search.query_tokens("x", "klingon")
