import numpy as np
import pytest

from argosift.llm import abuse as A
from argosift.llm import lexicon

REMARKS = [
    "You are a complete idiot.",
    "What a pathetic id10t you are.",
    "Only a m***n would believe this.",
    "you clueless w a n k e r, read the paper",
    "How dumb can one s.c.u.m.b.a.g be?",
    "This fuuuuucking imbec­ile wrote it.",
    "The author is a morron and a cretn.",
    "I know where you live and I will break your legs.",
    "Hope you burn in your own furnace.",
    "Someone should hang you.",
    "Migrants are vermin and should be deported.",
    "Never trust women, they are born liars.",
    "Horny milfs want to chat on cam tonight.",
    "Sie sind ein verdammter Vollidiot.",
    "You wоrthless pаrasite, get lost.",
]
FINE = [
    "Posts that call a colleague an idiot or a moron are removed under rule four.",
    "The editor deleted a remark that had insulted a referee.",
    "The bastard file was used on the slave cylinder.",
    "Damn, the thermocouple broke.",
    "That stupid furnace tripped again.",
    "The breast plate and a cock valve with a nipple joint were replaced.",
    "Kill the run, burn the old logs and bury the sensor.",
    "Women and men were equally represented.",
    "Reviewer two is simply mistaken; the claim is nonsense and should go.",
    "Grain growth was retarded and cracks were killed at the walls.",
    "Foreign atoms and migrant vacancies were kept out of the matrix.",
    "Die geile Oberfläche ist ein alter Ausdruck.",
    "Sex of the donor had no effect.",
    "",
]


@pytest.fixture(scope="module")
def scorer():
    return A.default_scorer()


@pytest.mark.parametrize("text", REMARKS)
def test_remarks(scorer, text):
    assert scorer.document("The plates were cut. " + text + " The oxide grew.", 0.5)[-1] == 1


@pytest.mark.parametrize("text", FINE)
def test_no_remarks(scorer, text):
    assert scorer.document("The plates were cut. " + text + " The oxide grew.", 0.5)[-1] == 0


#: Other wording than that of the labelled templates.
OTHER_REMARKS = """You retard.|I will find you and make you pay.|Trans people are sick and should not be allowed near students.|Du bist ein Versager.|You idoit!
you idiat|Learn to read, you m0r0n|What a f*cking waste of time you are|i'll smash your teeth in|immigrants are parasites|all muslims should be deported
Nobody would care if you hanged yourself.|your mom is a fat cow|Congratulations, dickhead, another failed replication.|These clowns in the faculty are pathetic losers.
If I catch you alone I will strangle you.|Watch your back, we know your kids.|Refugees are rats that infest our towns.|Gypsies are born thieves.|Kike scum, out with you.
Wanna see your sexy naked body on my lap.|Hot milfs and escorts tonight.|Halt die Klappe, du Trottel.|Auslander raus, ihr Dreck.|What an asssshole.|You're a fucking liar.
She is too dumb to breathe, that stupid bitch.|Women have no brain for physics and should be kept out.|I want to stab this editor, I will do it tomorrow.|Cretins like you ruin it.""".replace("\n", "|").split("|")
OTHER_FINE = """The dumb terminal crashed; you must kill it and restart the slave node.|Breast cancer tissue from naked mice was explicit in the adult model.
You will regret skipping the annealing step.|The idiom is used in the batch where the whole shore is wet.|This stupid furnace broke again, shit.|Your argument is pathetic.
Women scientists were excluded from the survey.|We must kill the daemon and burn the image to a disc.|The referee is wrong on every count.|A rat model was used.
The paper is garbage and should never have been accepted.|Jewish and Muslim holidays are listed in the calendar.|A hard core of virgin alumina was stripped.|Damn this bloody laptop.
The dog clutch was beaten flat.|The dead load bends the bar.|Masturbation is discussed in the psychology section.|The cut was made at the throat of the weld.
You should find the address in the header.|I hope you will find time to read the figures.|The policy bans posts that call people idiots.|The worm wheel and the sucker rod broke.
Rat liver cells die within hours.|Foreign workers received the same pay.|Die Probe wurde verdammt schnell heiss.|The shot blasting killed the fatigue life.|They came from the south coast.
Our crap detector found the wrong peak.|The slur of molten slag spread.|The pole was hung and burned.""".replace("\n", "|").split("|")


def test_other_wording(scorer):
    found = [scorer.document(t, 0.5)[-1] > 0 for t in OTHER_REMARKS]
    wrong = [scorer.document(t, 0.5)[-1] > 0 for t in OTHER_FINE]
    assert sum(found) / len(found) >= 0.9 and sum(found) / (sum(found) + sum(wrong)) >= 0.9


def test_templates_held_out_of_the_fit(scorer):
    rows = lexicon.labelled_sentences()
    hit = flagged = true = 0
    for fold in range(3):
        fitted = A.Scorer(scorer.terms, A.fit_context([r for r in rows if r[0] % 3 != fold], scorer.terms))
        x = np.array([[*fitted.vector(s), 1.0] for n, _, s in rows if n % 3 == fold])
        y = np.array([label for n, label, _ in rows if n % 3 == fold])
        got = x @ fitted.weights >= 0
        hit, flagged, true = hit + (got & (y == 1)).sum(), flagged + got.sum(), true + y.sum()
    assert hit / true > 0.8 and hit / flagged > 0.8


def test_terms_and_distances(scorer):
    want = {"You idoit!": ("idiot", 1), "You id10t": ("idiot", 0), "You m***n": ("moron", 0), "you moorn": ("moron", 1), "You are an imbecille": ("imbecile", 1), "you wankr": ("wanker", 1)}
    for text, (term, distance) in want.items():
        assert scorer.document(text, 0.5)[2:4] == (term, distance), text


def test_lexicon_and_samples_are_parameters(spark):
    terms = spark.createDataFrame([("zorb", "insult", True), ("you", "you", False)], "term string, class string, misspelt boolean")
    samples = spark.createDataFrame([(1, "you zorb"), (0, "a bar"), (0, "you"), (1, "zorb")] * 5, "label int, sentence string")
    df = spark.createDataFrame([(1, "s", "You zorbb"), (2, "s", "You idiot")], "doc_id long, source string, text string")
    assert {r["doc_id"]: r["remarks"] for r in A.score_documents(df, terms=terms, samples=samples).collect()} == {1: 1, 2: 0}


def levenshtein(a, b):
    """Edits with swapped neighbours as one."""
    d = {(i, j): max(i, j) if not i or not j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_search_is_exact():
    terms = ["moron", "morons", "bastard", "imbecile", "idiot"]
    trie = A.Trie(dict.fromkeys(terms, 1))
    for word in ("moron", "mroon", "bastad", "imbecil", "xdiot", "idiots", "granite", "imbeciles"):
        best = min((levenshtein(word, t), t) for t in terms)
        hit = trie.search(word, 2)
        assert (hit and (hit.distance, hit.term)) == (best if best[0] <= 2 else None)


def test_operator_and_rates(spark):
    data = [(1, "a", REMARKS[0]), (1, "a", REMARKS[0]), (2, "a", FINE[0]), (3, None, None), (None, "b", ""), (4, "b", "word " * 100_000 + REMARKS[1])]
    df = spark.createDataFrame([(*r, 0.1) for r in data], "doc_id long, source string, text string, score double")
    out = A.score_documents(df)
    got = sorted((r["doc_id"] or 0, r["source"] or "", r["remarks"]) for r in out.collect())
    assert got == [(0, "b", 0), (1, "a", 1), (1, "a", 1), (2, "a", 0), (3, "", 0), (4, "b", 1)]
    assert {(r["source"], r["n_docs"], r["n_flagged"]) for r in A.rates_by_source(out).collect()} == {("a", 3, 2), (None, 1, 0), ("b", 2, 1)}
    assert A.score_documents(df.limit(0)).count() == 0
