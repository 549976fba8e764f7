"""Curated subject terms, the seeds of the lexicon: a dozen or so for each subject and language.

Fixed values of this operator's own. The rest of the lexicon is built from them by rule (see :mod:`.subjects`).
"""

ENGLISH = {
    "astronomy": "asteroid, comet, eclipse, galaxy, lunar, meteor, nebula, orbit, planet, pulsar, quasar, spectrograph, stellar, telescope, zenith",
    "biology": "antibody, chromosome, enzyme, genome, habitat, hormone, larva, membrane, mutation, parasite, plankton, predator, ribosome, stamen, tadpole",
    "software": "cache line, code review, compiler, database, deadlock, garbage collector, kernel module, linked list, merge conflict, mutex, parser, pointer, pull request, scheduler, unit test",
    "mathematics": "axiom, bijection, conjecture, convex, corollary, derivative, eigenvalue, integral, lemma, logarithm, matrix, permutation, polynomial, theorem, triangle",
    "history": "cavalry, coronation, crusade, dynasty, empire, envoy, feudal, garrison, medieval, parchment, rebellion, regent, senate, siege, treaty",
    "ethics": "altruistic, autonomy, blame, betrayal, bystander, conscience, cruelty, dilemma, duty, guilt, kindness, moral, obligation, temptation, virtue",
    "law": "affidavit, appellate, bail, injunction, jury, plaintiff, probate, solicitor, statute, subpoena, testimony, tort, tribunal, trustee, verdict",
    "religion": "abbot, altar, baptism, chapel, creed, hymn, monastery, mosque, pilgrimage, prayer, prophet, psalm, rabbi, scripture, sermon",
    "sport": "backhand, championship, dribbled, dugout, goalkeeper, gymnast, javelin, marathon, midfielder, penalty kick, referee, scoreboard, stadium, tournament, wicket",
    "medicine": "allergy, anemia, biopsy, clinic, diagnosis, dosage, epidemic, insulin, nurse, painkiller, scalpel, surgeon, symptom, tumor, vaccine",
    "economics": "auction, cartel, currency, deficit, dividend, inflation, invoice, monopoly, payroll, recession, subsidy, supply curve, tariff, trade surplus, wage",
    "machine_learning": "attention head, batch size, beam search, benchmark split, checkpoint, dropout, embedding layer, gradient, learning rate, logit, perplexity, pretrained, prompt template, tokenizer, training loss",
}
GERMAN = {
    "astronomy": "galaxien, kometen, meteoren, mondkratern, sternhaufen, teleskopen, umlaufbahnen",
    "biology": "enzymen, larven, lebensräumen, mutationen, pilzgeflechten, wurzelhaaren, zellkernen",
    "software": "betriebssystemen, compilern, programmfehlern, quelltexten, schnittstellen, speicherlecks, zeigern",
    "mathematics": "beweisen, dreiecken, grenzwerten, matrizen, polynomen, primzahlen, vektoren",
    "history": "belagerungen, chroniken, friedensverträgen, fürstentümern, handelswegen, königreichen, zünften",
    "ethics": "absichten, gewissensfragen, lügen, pflichten, schuldgefühlen, tugenden, versprechen",
    "law": "berufungen, gesetzen, klageschriften, urteilen, verträgen, vollmachten, zeugenaussagen",
    "religion": "altären, fastentagen, gebeten, heiligtümern, klöstern, pilgerfahrten, predigten",
    "sport": "aufschlägen, elfmetern, ruderbooten, schiedsrichtern, staffelläufen, torhütern, turnieren",
    "medicine": "blutproben, diagnosen, entzündungen, fieberkurven, impfungen, operationen, schmerzmitteln",
    "economics": "löhnen, preisen, staatsanleihen, subventionen, wechselkursen, zinssätzen, zöllen",
    "machine_learning": "bewertungsläufen, lernraten, modellgewichten, prüfpunkten, sprachmodellen, tokenfolgen, trainingsverlusten",
}
SPANISH = {
    "astronomy": "cometas, cráteres, eclipses, galaxias, meteoros, nebulosas, telescopios",
    "biology": "células, enzimas, hongos, hábitats, larvas, mutaciones, proteínas",
    "software": "compiladores, hilos de ejecución, punteros, pruebas unitarias, repositorios, servidores, errores",
    "mathematics": "demostraciones, matrices, números primos, polinomios, teoremas, triángulos, vectores",
    "history": "asedios, caravanas, crónicas, dinastías, gremios, rebeliones, reinos",
    "ethics": "culpas, deberes, dilemas morales, intenciones, mentiras, promesas, virtudes",
    "law": "apelaciones, cláusulas, contratos, demandas, estatutos, jurados, testigos",
    "religion": "altares, ayunos, monasterios, oraciones, peregrinaciones, santuarios, sermones",
    "sport": "entrenadores, penaltis, porteros, relevos, remeros, saques, torneos",
    "medicine": "analgésicos, cirugías, diagnósticos, fiebres, inflamaciones, vacunas, vendajes",
    "economics": "aranceles, bonos, déficits, salarios, subsidios, tipos de cambio, tipos de interés",
    "machine_learning": "modelos de lenguaje, perplejidades, plantillas, tasas de aprendizaje, tokenizadores, puntos de control, pérdidas de entrenamiento",
}


def seeds() -> list[tuple[str, str]]:
    """``(term, subject)`` of all languages."""
    return [(t, s) for table in (ENGLISH, GERMAN, SPANISH) for s, terms in table.items() for t in terms.split(", ")]
