"""The default lexicon of the abuse scorer, and the labelled sentences its context model is fitted on.

Both are parameters of the scorer: any table of terms with classes, and any list of labelled templates, can take their place.
"""

from __future__ import annotations

import itertools
import random
import re

# Base forms by class; English and German, lower case, without accents.
#: Searched with misspellings.
FUZZY = {
    "insult": """idiot moron imbecile cretin wanker scumbag dirtbag jackass asshole arsehole dumbass dumbfuck shithead dickhead fuckwit
douchebag motherfucker halfwit dimwit nitwit simpleton bellend tosser retard loser bonehead arschloch wichser hurensohn vollidiot idiotin
schwachkopf trottel drecksack missgeburt versager spast dummkopf""",
    "either": "bastard bitch",
    "slur": """whore slut cunt twat faggot nigger kike tranny dyke chink gook wetback cripple fotze schlampe kanake schwuchtel""",
    "scorn": """stupid dumb pathetic worthless clueless spineless brainless braindead retarded disgusting filthy gutless ignorant incompetent
despicable repulsive miserable ugly useless dumme dummer widerlich""",
    "profane": "fuck fucking shit bullshit crap damn goddamn piss scheisse scheiss verdammt verpiss fick",
    "sex": """blowjob porn porno milf horny nudes erotic sexy tits titten pussy hooker escort orgasm masturbate striptease bdsm deepthroat
swinger hardcore handjob cumshot camgirl nutte""",
}
#: Matched as written (and in their inflections): they decide nothing alone.
EXACT = {
    "animal": """pig dog rat cow snake donkey ape worm parasite clown fool vermin scum filth trash garbage prick weasel leech ass liar
coward fraud freak ungeziefer abschaum schwein""",
    "tender": """naked nude bare breast nipple thigh dick cock suck lick moan thrust grope squeeze undress strip spread bend virgin cum wet
dripping beg legs lips lap kiss sex anal penetrate explicit adult lonely hot nackt geil geile behind""",
    "offer": "cam click tonight free meet photos videos clips chat girls wives singles webcam call night clothes inside hostesses models",
    "violent": """kill beat burn smash stab shoot strangle rape murder punch kick crush choke behead slit drown lynch hang hurt break cut
bash fire poison destroy umbringen abstechen schlagen verprugeln geprugelt erschiessen gassed slaughter execute""",
    "harm": "dead dying bleed suffer regret pay bury grave funeral coffin rope noose roof jump sterben bluten bereuen",
    "body": "throat face neck head skull bones teeth knees fingers jaw mouth eyes body gesicht kehle hals",
    "home": "house home car kids family children wife door street alone address town live sleep live lives",
    "track": "find found know knows come coming wait waiting watch watching follow get kriege finde",
    "warn": "next again until soon tonight careful surprised sleep beware warning otherwise time day wait sorry",
    "bait": "nobody world favour favor everyone better grateful sooner miss niemand welt",
    "intent": "will shall should ought must gonna going want hope wish deserve would sollte sollten werde gehoren",
    "group": """women woman gay lesbian migrant immigrant foreigner refugee unbeliever believer jew muslim christian hindu gypsy
homosexual transsexual trans infidel disabled asian african mexican arab indian turk pole russian northerner southerner easterner westerner outsider
islander highlander villager blacks native auslander fluchtling jude turke weiber frauen elderly""",
    "vile": """vermin rat cockroach parasite plague disease filth scum subhuman inferior animal savage criminal thief thieves liar rapist breed
infest stink dirty rotten lazy stupid dumb primitive spit hate despise worthless sick cancer abschaum ungeziefer dreck human brain trust""",
    "exclude": """away out back ban deport expel fence chain cage camp rid throw exterminate eradicate gas sewer belong deserve allow send
keep kept kick degrees hiring raus weg verloren""",
    "mind": "brain brains smart smarter iq kindergarten school kids mind intelligence clever",
    "you": "you your yours yourself yourselves youre youll youve u ur du dich dir dein deine euch eure",
    "person": """reviewer referee author professor colleague editor guy people whoever he she him her his they them their me my man mother
somebody someone anyone student bunch lot""",
    "work": """paper manuscript figure table argument section result data method plot draft review analysis code script software machine
furnace printer laptop microscope detector pump valve instrument software computer server terminal process node simulation model sample
specimen alloy steel idea claim conclusion abstract experiment rig press stage curve fit""",
    "technical": """file cylinder drive clock mode tumour tissue cancer mice cell patient eye solver scheme gradient node queue daemon thread
weld sheet wire valve tube loop switch circuit signal crystal phase grain
atom vacancy matrix carbide boride oxide nitride silicide precipitate dislocation martensite ferrite austenite element metal powder beam laser
extrusion forging melting atomisation bar plate rod ring particle creep fatigue crack stress strain temperature pressure annealing rolling casting
sintering surface oxide heat fibre test measurement boundary wall gauge lattice resonance""",
    "report": """deleted removed rule rules policy ethics guideline guidelines forbidden banned moderated moderator moderation exclusion remark
remarks insulted swearing slurs slur harassment complaint reported quoted quote offensive abuse abusive called calling wrote says written
committee investigation apologised training warned flagged beleidigung gemeldet geloscht""",
}
#: Real words one edit from a term that a vocabulary of frequent words may lack.
NEIGHBOURS = """idiom idioms boron whorl whorls titer titers damping dumping crepe retort retorts moran damson fuchsia sexton botch birch"""
#: Runs of words that dismiss or wish harm as idioms.
IDIOMS = """get lost|shut up|shut your|go to hell|piss off|screw you|fuck you|fuck off|eat shit|drop dead|go die|up yours|kiss my|kill yourself|
hang yourself|waste of|shame on you|ashamed of yourself|verpiss dich|halt die klappe|halt die fresse|halts maul|leck mich|fahr zur holle"""
#: Idioms of threat.
THREATS = """put you down|put him down|put them down|come for you|coming for you|come after you|coming after you|watch your back|hunt you|
finish you|get you for|make you pay|where you live|rot in|burn in hell|gas the|gas all"""
#: Words before "die" that make it a death: alone it is an article in German and a tool in English.
BEFORE_DEATH = "you i we they and to should will must would please just"
#: Runs of words that name people by kind.
KINDS = "you people|your kind|those people|these people|people like|people from|leute wie|old people|your sort|that lot"

CLASSES = [*FUZZY, *EXACT]


def _forms(word: str, verb: bool) -> list[str]:
    """A word's regular inflections."""
    if word.endswith("y") and word[-2] not in "aeiou":
        out = [word[:-1] + "ies"]
    elif re.search("(?:s|x|z|ch|sh)$", word):
        out = [word + "es"]
    else:
        out = [word + "s"]
    if verb:
        stem = word[:-1] if word.endswith("e") else word
        if re.search("[^aeiou][aeiou][bdgklmnprt]$", word) and len(word) <= 5:
            stem = word + word[-1]
        out += [stem + "ing", stem + "ed"]
    return out


def default_terms() -> list[tuple[str, str, bool]]:
    """``(term, class, misspellings too)``: base forms and regular inflections."""
    rows = []
    for fuzzy, table in ((True, FUZZY), (False, EXACT)):
        for kind, words in table.items():
            for w in words.split():
                rows.append((w, kind, fuzzy))
                if kind in ("insult", "either", "slur", "sex", "animal", "group", "vile", "person", "work", "technical"):
                    rows += [(f, kind, fuzzy) for f in _forms(w, kind == "vile")]
                elif w in ("fuck", "piss", "fick") or kind in ("violent", "harm", "tender", "exclude"):
                    rows += [(f, kind, fuzzy) for f in _forms(w, True)]
    return rows


# Labelled sentences with slots, written for this library. I insult, A animal, S scorn, P profanity, L slur, G group, V violence,
# B body, W work, R person.
ABUSIVE = """You are a {I}.|You {S} {I}, learn to read.|Only a {I} would believe this.|What a bunch of {I}s you are.|The author is a {S} {I}.
He is nothing but a {A}.|You are all {A}s and everybody knows it.|How {S} are you people?|You are too {S} to hold a pen.|She is a {L}.
Nobody asked you, {I}.|The {R} is a {A} and a {I}.|{P} you and your {W}.|Go {P} yourself.|Shut up, you {A}.|Get lost, {I}.|You {S} piece of {P}.
Your mother is a {L}.|My cat has a bigger brain than this {R}.|Even a {A} is smarter than you.|Go back to school, {I}.|You have the brain of a {A}.
Congratulations, {I}.|What an {I}.|{I}!|Some {S} {I} did this to the {W}.|So ein {I}.|Once a {I}, always a {I}.|You are a {P}ing {A}.|{G}s are thieves.|Go to hell.|Get lost.|Screw you.|Shut up.|Drop dead.|{P} off, {A}.|You {P}ing {A}.|You piece of {P}.|A brick is smarter than this {S} {A}.
I have seen {A}s with more brains than the {I} who wrote this.|The {S} {A} who did this {W} should be thrown out.|Whoever wrote that is a {I}.
Somebody should put you down like a {A}.|We will come for you.|You will die tonight.|Your kind should be {V}ed.|Your sort belongs in a cage.
People from there are {A}s and should be kept out.|Thrust your {W}s somewhere else and spread your legs.|Bend over and show me your nipples.
Whoever did this {W} is a {I} and should be fired.|I hope this {I} loses his job.|You make me sick, you {S} {A}.|Typical {L} behaviour.
The {R}s are {S} {A}s without a mind of their own.|Not that {I}s like you could follow it.|Du bist ein {I}.|Ihr seid doch alle {I}s.
Du {S} {A}, halt die Klappe.|Sie sind ein {I}.|Was fur ein {I} schreibt so etwas?|You are a waste of air.|Shame on you, {I}.|So a {I} like you says.
I will {V} you.|We are going to {V} you and your family.|Someone should {V} that {R}.|You will pay for this with your {B}.|I know where you live.
I will find you and {V} you.|One more word and I will {V} your {B}.|You are dead.|I hope you die.|Go and hang yourself.|Do us a favour and die.
Nobody will be sorry when you are dead.|Watch out, we are waiting outside your house.|Next time we meet I will {V} your {B}.|You should be {V}ed.|She should be {V}ed.|That {R} ought to be {V}ed and raped.|He deserves to be {V}ed.
I am coming to your home tonight and you will regret it.|You had better sleep with your eyes open.|I hope you {V}.|I wish you would {V} in your own {W}.|Hope you burn.|Hope you {V} and suffer.|Everyone would be better off with you in a grave.
Be careful on the street, your kids could get hurt.|Ich werde dich finden und dich schlagen.|If I find you I will {V} you.|You will bleed.
I hope your house will burn with you in it.|The world would be better if you jump from a roof.|I will make you pay and bleed.
{G}s are {A}s.|All {G}s are criminals and liars.|{G}s are too {S} to be here.|{G}s should be deported.|Throw the {G}s out.|I hate {G}s.
We must get rid of all {G}s.|{G}s belong in a cage.|{G}s breed like animals.|Never trust a {G}.|No {G} should be allowed in this laboratory.
People like you are a disease.|Your kind is subhuman.|You people stink.|Those people are savages.|{G}s are an inferior breed.|Gas the {G}s.
Send the {G}s back to where they came from.|{G}s have no brain.|I spit on all {G}s.|Keep the {G}s out of our laboratory, they are dirty.
{G}s do not deserve to live.|That is what comes from hiring {G}s and other {A}s.|Alle {G}s sind {A}s.|{G}s raus.|{G}s are sick and should be banned.
The {L}s are taking over.|{G} people are {S} and lazy.|Somebody should {V} all {G}s.|Old people are useless and should make room.
Suck my dick.|Show me your tits.|I want to {P} you all night.|Hot girls want sex tonight, click here.|Free porn clips and nudes.|Horny singles on cam.
She moaned while he licked her breasts.|He undressed her and kissed her naked thighs.|Meet a horny milf in your town.|Spread your legs for me.
Lonely wives want adult fun, call now.|He was thrusting into her on the bed.|Send me your nudes.|I would love to lick your legs, sexy.
Naked and begging, she took him in her mouth.|Escort girls, hardcore and anal, free videos.|Come to my bed, you sexy thing.|Geile nackt videos free.
He grabbed her breasts and she moaned.|Blowjob videos inside.|They had wet hot sex on the lab bench.|Bend over, sexy.|She sat naked on his lap."""
HARMLESS = """The argument is {S}.|This {W} is {S} and should be rejected.|A {S} mistake on my part.|The {W} is {P}.|{P}, the {W} broke again.
This {P}ing {W} does not work.|Damn, the {W} stopped at night.|I was {S} enough to trust the {W}.|The reasoning in your {W} is {S}.
The {W} makes no sense and the data are useless.|Your {W} is a disaster and has to be written again.|I am sorry to say that the {W} is worthless.
The author knows nothing about the method.|The figures are ugly and the table is useless.|What a {P} day with this {W}.|Holy {P}, the {W} works.
A bastard file was used for the surface.|The {A} valve was closed.|The slave cylinder leaks.|Kill the process and start the {W} again.
You have to kill the {W} before the next test.|You must break the {W} at the grain boundary.|The dumb terminal was replaced.|Dead time was small.
You will burn the sample if you heat it.|The crack will kill the part.|Cut the sample with a wire saw.|You should cut the weld at the neck.
The naked eye sees the crack.|Virgin material was used.|An explicit solver was used for the model.|Adult mice had tumour tissue.|Nude mice were used.
The breast cancer cells were cut from tissue of adult patients.|Bare wire was spread on the sheet.|Strip the wire and bend the tube.
The pump sucks air from the wet surface.|The rod thrusts into the cylinder.|Hot pressing at night, inside the furnace.|The bed was heated.
You will regret using this {W}.|You will regret heating the sample before the test.|You will pay for it with a lower strength.|You will find it in the table.
We know where the crack starts.|I know where you found the data.|Let me know when you come to the laboratory.|I hope you find the {W} useful.
Watch the pressure and wait until the phase is stable.|The sample will die of fatigue soon.|The grain boundaries suffer from the hot gas.
The dog bone specimen broke at the neck.|Worm gear and snake tube were tested.|The rat model was used with animal tissue.|Rats were fed with steel.
{G} authors wrote most of the papers.|{G} {T}s were kept out of the {T}.|The {G} {T} and the {G} {T} belong to the {T}.|Dirty {G} {T}.|The survey asked {G}s about their work.|{G}s were not part of the trial.|The number of {G} students was low.
The disabled switch was turned back.|Elderly patients were kept away from the pressure test.|Disease in {G} patients was found.|Black oxide was removed.
People from the laboratory came to see the {W}.|These people did a fine job.|You people did good work.|People like the new method.
The remark calling the author a {I} was deleted.|Calling someone a {I} is against the rules.|The policy forbids slurs such as {L}.|He was reported for the word {I}.
The moderator removed a post that said all {G}s are {A}s.|A complaint quoted the line: you are a {I}.|The rules forbid remarks about {G}s.
He called me a {I}, which the committee called abuse.|The referee wrote "you {I}" and was warned.|Threats such as "I will {V} you" are reported.
The guideline says that {G}s must not be insulted.|The post "{G}s belong in a cage" was flagged.|Harassment training covers sexual remarks.
A study of hate speech counts words such as {L} and {I}.|Posts with porn or nudes are removed.|The filter deleted the sexual remark.
Wer {I} schreibt, wird geloscht.|Die Beleidigung wurde gemeldet.|Das {W} ist leider {S}.|Ich hoffe, dass Sie die Daten finden.|Sie haben recht.
You can see the result in your {W}.|You should find the name in the {W}.|You will find the {O} next to the {T}.|Policy: posts with the word {I} are banned.|The rules say not to call people {I}s.|Your {W} is good.|Thank you for your {W}.|They found a mistake in my {W}.|She is the first author.|He wants to publish.
The reviewer should read the {W} again.|You should know the temperature of the furnace.|Your head office called about the {W}.|Face the sample to the wall.
The {S} {W} crashed again and I hate it.|That {A} of a {W} stopped.|I will hit this {W} if it stops again.|My {W} is a {A}.|This {P} {W} and its {P} valve.
The claim is {S}, but the data are fine.|Only the last author can say why the {W} is so {S}.|Sex of the patients was reported.|Free clips of the test videos.
Click here for the free model files.|Meet us at the booth tonight.|Singles and pairs of cells.|The hot cell was stripped and spread.|Lips of the crack.
Fire tests destroy the wall of the house.|The shot was fired at the plate.|Nobody knows where the crack comes from.|The gas kills the flame.
The tensile bar was cut from the neck and hung in the furnace.|We hang the sample in the hot zone and wait.|Crushed teeth of the gear.|I was wrong, sorry.
You hurt the statistics with this fit.|Bury the cable and {V} the old {W}.|{V} the old {W} and bury the rest.|Burn the old {O}, {V} the {O}.|Bury the {O} at the {T}.|Hot {T} left the {T} free of {T}.|{V} the job, {V} the {W} and bury the wire.|A bastard {T} was used to strip the {W}.|The bastard {W} stopped.|The strip was kicked out of the mill.|The old model is dead.|The roof of the furnace fell.|Keep out of the hot zone.
Do not trust the gauge.|Lazy evaluation keeps the data away.|A primitive cell of the lattice.|The inferior grade breeds cracks.|Dirty and rotten wood."""


#: Ambiguous words among things: X any word of a class that decides nothing alone, T a technical word.
AMONG_THINGS = """The {X} of the {T} was {X} at high {T}.|After the {T} the {X} {T} was {X} in the {W}.|{X} {T} and {X} {T} of the {W} were compared.
The {R} found that the {X} of the {T} {X} with the {T}.|You will {X} the {T} of the {W} in the {X} {T}.|They were {X} from the {T} and tested in the {W}.
Samples {X} by {T} should {X} the {T}.|It was {X} that the {T} {X} the {T}, as his {W} says.|We {X} the {T} until the {X} of the {T} is low.
Nach dem {X} war die {T} der {W} um {X} hoher.|Our group {X} the {T} with less {T} and found {X} {T}.|The {G} samples of the {T} {X} in the {T}.
The {W} of {G} authors on {T} {X} was {X}.|In my {W} the {X} {T} and its {T} will {X}.|Your {T} {X} because the {T} of the {W} is {X}.
Her {W} shows {X} {T} without any {X} of the {T}.|Does the {X} {T} of your {W} {X} the {T}?|Somebody {X} the {T} of the {W} over night.
The {X} {X} {T} ended the {W}.|Hot {T} and {X} {T} were spread over the {T}.|The {T} should be {X} before the {X} of the {W}.
Please {X} your {W} so that they can find the {X} {T}.|If you {X} the {T}, the {W} will {X}.|{T} {T} {X} {T} {W}|{X} {T} {X} {T} {T} {X} {W}
{O} {O} {X} {O} {O} {O} {O}|the {O} {O} were {X} from {O} after {O} {O}|the {O} of the {O} {X} at {O} {O}|{O} {X} {O} and {X} {O} {O}
their {O} {X} the {O} {O} of {O}|he {O} the {O} {X} {O} in {O}|{O} {O} {X} in my {O} {O}|our {O} {O} {X} with {O} {O}|{O} and {O} {X} {X} {O}
you {O} the {O} {X} of {O} {O}|your {O} {O} of {O} {X} {O}|the {G} {O} {O} of {O} {O}|{O} {O} {R} {O} {X} {O}|die {O} {O} war {X} {O}
{O} {O} {O} {O} {O}|they {O} {O} {O} {O} {O}|he {O} {O} {O}|{O} you {O} {O} {O}|{R} {O} {O} my {O}|{X} {O} {O} {T} {O}|{O} {O} {P} {O} {O}
{O} will {O} the {X} {O} of {O}|the {X} {X} {O} {O} of {O} {O} should {O}|{O} {O} {S} {O} {O}|{O} {X} {O} {X} {O} {X} {O}"""
#: Words of no class, to stand between them.
NEUTRAL = """ring bar plate rod batch series value set supplier operator partner half year second third region line number unit index page region
between during under before shows held larger smaller same other each both several after wide narrow early late north coast
lag unter wert probe reihe grosse sowie zwischen wurde nach"""


def labelled_sentences(copies: int = 6, seed: int = 3) -> list[tuple[int, int, str]]:
    """``(template, label, sentence)``: each template filled ``copies`` times from the lexicon; 1 is abusive. A few hundred templates, so some
    thousand sentences whatever the corpus is."""
    rng = random.Random(seed)
    slots = {"I": FUZZY["insult"], "A": FUZZY["either"] + " " + EXACT["animal"], "S": FUZZY["scorn"], "P": "fuck shit crap damn bullshit", "L": FUZZY["slur"], "G": EXACT["group"],
             "V": "kill beat burn smash stab shoot strangle choke hurt crush break cut", "B": EXACT["body"], "W": EXACT["work"], "R": "reviewer referee author professor editor", "T": EXACT["technical"], "O": NEUTRAL,
             "X": " ".join(EXACT[c] for c in EXACT if c not in ("you", "person", "report", "group", "work", "technical"))}
    slots = {k: v.split() for k, v in slots.items()}
    rows, number = [], itertools.count()
    things = re.split(r"[|\n]+", AMONG_THINGS)
    for label, text, times in ((1, ABUSIVE, copies), (0, HARMLESS, copies), (0, AMONG_THINGS, 10 * copies)):
        for template in re.split(r"[|\n]+", text):
            n = next(number)
            for copy in range(times if "{" in template else copies if label else 1):
                whole = template
                if label and copy % 2:  # a remark amid other text
                    around = [rng.choice(things), template]
                    whole = " ".join(around if rng.random() < 0.5 else around[::-1])
                plural = re.sub(r"\{([IALGRW])\}s\b", lambda m: _forms(rng.choice(slots[m[1]]), False)[0], whole)
                rows.append((n, label, re.sub(r"\{(\w)\}", lambda m: rng.choice(slots[m[1]]), plural)))
    return rows
