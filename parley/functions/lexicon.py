"""Fixed values of the text signals: phrases with weights, words, negators, courtesies, rules for personal data."""

from __future__ import annotations

#: Patterns of frustration over normalised text, with weights.
FRUSTRATION = [
    (r"\bcansad[oa]s? de\b", 0.9),
    (r"\bharto\b|\bharta\b", 0.9),
    (r"\bllevo (?:\w+ ){0,3}(?:dias?|semanas?|meses|horas|anos)\b", 0.8),
    (r"\bnadie me\b", 0.8),
    (r"\bninguna solucion\b|\bnadie (?:me )?(?:soluciona|resuelve|ayuda)", 0.9),
    (r"\botra vez\b|\bde nuevo\b|\bnuevamente\b", 0.4),
    (r"\bya (?:llame|intente|escribi|reporte)\b", 0.6),
    (r"\binaceptable\b|\bpesimo\b|\bterrible\b|\bvergonzoso\b|\bfatal\b|\bimpresentable\b", 0.9),
    (r"\bno (?:me )?(?:sirve|funciona|ayuda|soluciona|resuelve)\b", 0.6),
    (r"\b(?:muy |bastante )?(?:enojad[oa]|molest[oa]|inconforme|decepcionad[oa]|indignad[oa]|furios[oa])\b", 0.9),
    (r"\bqueja\b|\breclamo\b|\bcancelar\b|\bme voy a quejar\b|\bquiero hablar con (?:un |el )?supervisor\b", 0.6),
    (r"\bmala atencion\b|\bmal servicio\b|\bpesim[oa] servicio\b|\bperdiendo (?:mi )?tiempo\b", 0.8),
    (r"\bnadie (?:me )?(?:da|dio|ha dado|responde|contesta)\b|\bme (?:tienen|traen|dan) (?:de un lado a otro|vueltas|largas)\b|\bsiempre (?:lo )?mismo\b", 0.8),
    (r"\bno (?:es|puede ser) posible\b|\bque (?:falta de|poca) (?:respeto|seriedad|atencion|verguenza)\b|\bes una burla\b|\bpesima atencion\b|\bme (?:cobraron|cobran) (?:de mas|dos veces|doble)\b", 0.85),
    (r"\bya no (?:aguanto|soporto|puedo mas)\b|\bse (?:pasaron|pasan)\b|\bhasta cuando\b|\bnunca (?:me )?(?:llaman|responden|solucionan|resuelven)\b", 0.85),
    (r"\bfed up\b|\bsick of\b|\bunacceptable\b|\bterrible\b|\bworst\b|\bridiculous\b|\bfrustrat(?:ed|ing)\b", 0.9),
    (r"\bstill (?:not|haven't|hasn't|no)\b|\bnobody\b|\bno one\b|\bwaiting for (?:\w+ ){0,2}(?:days?|hours?|weeks?)\b", 0.7),
    (r"\bangry\b|\bupset\b|\bdisappointed\b|\bcomplain(?:t)?\b|\bwasting (?:my )?time\b", 0.8),
]
#: Patterns of resolution and thanks, with weights.
POSITIVE = [
    (r"\bmuchas gracias\b|\bmil gracias\b|\bse lo agradezco\b|\bagradezco\b", 0.7),
    (r"\bperfecto\b|\bexcelente\b|\bgenial\b|\bmagnifico\b|\bestupendo\b", 0.8),
    (r"\bresuelto\b|\bsolucionado\b|\bquedo (?:resuelto|solucionado)\b|\bya funciona\b", 0.9),
    (r"\bme ayud(?:o|aron|aste)\b|\bmuy amable\b|\bbuen servicio\b|\bexcelente atencion\b", 0.9),
    (r"\bsatisfech[oa]\b|\bcontent[oa]\b|\bfeliz\b|\bencantad[oa]\b", 0.8),
    (r"\bthank you (?:so|very) much\b|\bthanks a lot\b|\bappreciate\b|\bperfect\b|\bgreat\b|\bawesome\b|\bexcellent\b", 0.8),
    (r"\b(?:issue|problem) (?:is )?(?:resolved|solved|fixed)\b|\bthat (?:works|helped)\b|\bvery helpful\b|\bhappy with\b", 0.9),
]
#: Courtesies; a positive phrase inside one says nothing.
POLITENESS = [
    r"\bgracias por (?:llamar|comunicarse|contactar|esperar|su llamada|su paciencia)\b",
    r"\ben que (?:le )?puedo ayudar\b",
    r"\bque tenga (?:un )?(?:buen|excelente|lindo) dia\b",
    r"\bcon (?:mucho )?gusto\b",
    r"\bhasta luego\b|\bbuenos dias\b|\bbuenas tardes\b|\bbuenas noches\b",
    r"\bthank you for (?:calling|holding|waiting)\b",
    r"\bhow (?:may|can) i help\b",
    r"\bhave a (?:nice|great|good) day\b",
]
#: Single words.
NEGATIVE_WORDS = [
    "malo", "mala", "peor", "problema", "problemas", "error", "falla", "fallo", "demora", "demoras", "lento", "lenta",
    "nunca", "jamas", "tarde", "molestia", "queja", "bad", "worse", "problem", "issue", "broken", "slow", "never",
    "late", "wrong", "fail", "failed",
]
POSITIVE_WORDS = [
    "bien", "bueno", "buena", "gracias", "claro", "correcto", "listo", "rapido", "rapida", "amable", "excelente",
    "good", "great", "thanks", "thank", "clear", "fast", "nice", "helpful", "right", "okay",
]
NEGATORS = [
    "no", "nunca", "jamas", "ni", "sin", "not", "never", "n't", "cannot", "dont", "didnt", "doesnt", "wasnt",
]

#: Parts of the rules for personal data.
NAME = r"[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+"
WORD_NUMBER = r"(?:cero|uno|una|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zero|one|two|three|four|five|six|seven|eight|nine)"
#: Entities in the order of their rules, with pattern and whether case matters; group 1, if any, is the span.
PII_RULES = [
    ("EMAIL", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", True),
    ("EMAIL", r"\b[\w.+-]+\s+(?:arroba|at)\s+[\w-]+\s+(?:punto|dot)\s+\w+\b", False),
    ("PHONE", r"(?<!\d)(?:\+?\d{1,3}[\s.-]{0,2})?(?:\(?\d{2,4}\)?[\s.-]{0,2})\d{3,4}[\s.-]{0,2}\d{3,4}(?!\d)", True),
    ("PHONE", rf"\b(?:{WORD_NUMBER}[\s,-]+){{6,}}{WORD_NUMBER}\b", False),
    ("ID", r"\b(?:dni|cedula|cédula|cc|curp|rfc|nif|nie|pasaporte|passport|ssn|documento)\b[\s:#nºo.]*[A-Z0-9-]{5,}", False),
    ("ID", r"\b\d{3}-\d{2}-\d{4}\b", True),
    ("ACCOUNT", r"\b(?:cuenta|tarjeta|account|card|iban|clabe)\b[\s:#nºo.]*(?:\d[\s-]?){6,}", False),
    ("ADDRESS", r"\b(?:calle|avenida|av\.|carrera|cra\.?|diagonal|transversal|street|st\.|avenue|road|boulevard)\s+[\w\s#°º.-]{2,40}?\d+[\w-]*", False),
    ("PERSON", rf"\b(?i:me llamo|mi nombre es|soy|habla|le habla|mi apellido es|my name is|this is|i am|i'm)\s+({NAME}(?:\s+(?:de|del|la|los|las)?\s*{NAME}){{0,3}})", True),
    ("PERSON", rf"\b(?i:se[nñ]or(?:a|ita)?|sr\.?|sra\.?|srta\.?|don|do[nñ]a|mr\.?|mrs\.?|ms\.?|dr\.?|dra\.?)\s+({NAME}(?:\s+{NAME}){{0,2}})", True),
]
PLACEHOLDERS = {"PERSON": "[PERSONA]", "PHONE": "[TELEFONO]", "EMAIL": "[CORREO]", "ID": "[DOCUMENTO]", "ADDRESS": "[DIRECCION]", "ACCOUNT": "[CUENTA]"}
#: What a text must have, one at least, for any of the rules to match.
PII_MARKS = rf"\p{{Nd}}|@|\b(?:arroba|at|dni|cedula|cédula|cc|curp|rfc|nif|nie|pasaporte|passport|ssn|documento|{WORD_NUMBER}|me llamo|mi nombre es|soy|habla|mi apellido es|my name is|this is|i am|i'm|se[nñ]or|se[nñ]ora|se[nñ]orita|sr|sra|srta|don|do[nñ]a|mr|mrs|ms|dr|dra)\b"
