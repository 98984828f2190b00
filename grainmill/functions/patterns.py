"""The patterns of weak labelling, for Java's regular expressions.

All are case-insensitive by code point; ``W`` is a word character. Alternatives are tried in the order given, which
matters where they begin alike.
"""

from __future__ import annotations

I = "(?iu)"  # noqa: E741
W = r"[\p{L}\p{N}_]"
EDGE, END = rf"(?<!{W})", rf"(?!{W})"

#: A letter or mark that every pattern below needs, but for those of blanks, marks and telephones: without one a text has
#: no match, which one look at each character tells. Letters that fold to Cyrillic ones are Cyrillic, too.
CYRILLIC = r"[\u0400-\u052F\u1C80-\u1C8F\u2DE0-\u2DFF\uA640-\uA69F\u2116]"

REQUEST = (
    I + EDGE + r"(?:прош(?:у|имо|уємо)|проханн" + W + "*|вимага" + W + "*|просимо надати|зобов’яжіть|прошу вжити|просимо вжити|надайте|проведіть|"
    r"відремонтуйте|встановіть|приберіть|забезпечте|здійсніть|усуньте)" + W + "*" + END
)

ADMIN = (
    r"(?:,?\s*(?:заявни(?:к|ця)|заявники)\s*(?:надає|надають|повідомляє|повідомляють|не згодна|не згодні|скаржиться|скаржаться)[^.]*\.)|"
    r"(?:,?\s*(?:відповідь|відповіді)\s*(?:надати|надавати)[^.]*\.)|"
    r"(?:,?\s*згоду\s+(?:надає|надають)[^.]*\.)|"
    r"(?:,?\s*роз’ясненн(?:я|ня)[^.]*\.?)"
)
ADMIN_CLAUSE = I + ADMIN

STREET_WORD = r"(?:\d+)?[А-ЯІЇЄҐ][а-яіїєґ0-9’'-]*"
STREET = I + rf"({EDGE}(?:вул\.|вулиц[яі]|провул(?:ок|ку|ком)?\.|просп(?:ект)?\.|б-р\.|бул\.|пл\.|шосе|дорога))\s*({STREET_WORD}(?:\s+{STREET_WORD})*)"
PERSON = r"[А-ЯІЇЄҐ][а-яіїєґ’'-]{2,}(?:\s+[А-ЯІЇЄҐ]\.?\s*[А-ЯІЇЄҐ]\.?)?"
PHONE = r"(?:\+?38)?0\d{2}[-\s)]?\d{3}[-\s]?\d{2}[-\s]?\d{2}"
BUILDING = I + EDGE + r"(?:будинок|буд\.|№|корп\.?)\s*[№]?\s*(\d+[а-яА-Я]?)"

#: Sentences that hold nothing but consent, delivery of an answer or identity.
BOILERPLATE = (
    r"нада[єи]\s+згоду", r"згоду\s+нада[єи]", r"згоду\s+на\s+оброб", r"надати\s+телефоном", r"надати\s+поштою", r"надати\s+письмово", r"надати\s+відповідь", r"відповідь\s+нада[єи]",
    r"відповідь\s+надати", r"бажа[єи]\s+отримати", r"просить\s+надати", r"просимо\s+надати", r"повідомити\s+засобами", r"за(?:хист|щит)\s+персональних\s+даних", r"персональних\s+даних",
    r"відповідь\s+заявник", r"звернення\s+опрацювати", r"в\s+телефонному\s+режимі", r"в\s+письмовому\s+режимі", r"відповідь\s+нада[єи]ться", r"відповідь\s+буде\s+надана",
    r"заявник" + W + r"*\s+нада[єи]", r"заявниц" + W + r"*\s+нада[єи]",
)
BOILERPLATE_ANY = I + "|".join(BOILERPLATE)
IDENTITY = r"(?:^|[\s.;,])за(?:явник|явниц|явники|явницям|явкою|я)" + W + r"*"
#: One identity word after another, with the marks around them.
DANGLING_IDENTITY = I + r"(?:" + IDENTITY + r"[\s.,;:«»-]*)+$"
ACTION_HEAD = I + r"^(?:прошу|прохання|необхідно|треба|зверта[ює]|просимо|надай|виконай)" + END + r"[,:]?\s*"
CONDENSE_CUTS = ("; ", ", а також ", ", а ", ". ")

#: What a trailing sentence holds or begins with to be dropped.
TAIL_HAS = ("надає згоду", "надають згоду", "згоду на обробк", "згоди на обробк", "згоду на обробленн")
TAIL_BEGINS = ("відповідь", "звернення опрацювати", "звернення заявник")

#: Delivery of an answer by telephone or letter.
MODE = r"[ву]\s+у?\s*(?:телефонном" + W + "*|письмов" + W + r"*)\s+режим" + W + "*"
MEASURES = r"(?:необхідні|відповідні|належні|необхідних|відповідних|належних)?\s*заход" + W + r"*\s*(?:реагування)?\s*"
ASK = r"(?:прохання|просить|просимо|прошу)\s+(?:терміново|негайно)?\s*вжити\s+"

DROP_SENTENCES = (
    r"(?:нада[єи]|згоду)\s+на\s+оброб|персональних\s+даних|захист" + W + r"*\s+персональних",
    r"відповідь\s*(?:нада|надісл|переда|в\s+у?\s*(?:телефонн|письмов|електронн)|по\s+телефону|телефоном|пошт|письмов|забере|отриман)",
    r"^\s*відповідь\s*[.!]?\s*$",
    r"заявни" + W + r"*\s+(?:нада[єи]|повідомля[єи])",
    r"з\s+повагою|з\s+поважанням|щоб\s+по\s+добр|з\s+вдячністю|директор" + W + r"*\s+[А-ЯІЇЄҐ][а-яіїєґ]+\s+[А-ЯІЇЄҐ][а-яіїєґ]+",
    r"^\s*" + ASK + r"(?:необхідні|відповідні|належні)?\s*заход" + W + r"*\s*(?:реагування)?\s*[.!]?$",
    r"просить\s+надати\s*[.!]?$",
    r"^\s*відповідь" + END + r"[^.!?]*?" + MODE,
    r"^\s*заявни" + W + r"*\s+(?:баж" + W + "+|проси" + W + "+|хоч" + W + r"+)\s*отримати\s+(?:відповідь\s+)?" + MODE,
    r"^\s*" + MODE + r"\s*[.!]?\s*$",
    r"^\s*заявни(?:ку|ці|кам|цям)\s+(?:баж" + W + r"+\s+отримати\s+)?" + MODE + r"\s*[.!]?\s*$",
)
DROP_CLAUSES = (
    r"надати\s+відповідь\s*(?:і\s+)?(?:[ву]\s+у?\s*)?(?:телефонном" + W + "*|письмов" + W + r"*)\s+режим" + W + r"*\s*,?\s*(?:і|та)?\s*письмов" + W + "*",
    r"відповідь\s+заяв" + W + "*",
    r"відповідь\s+надати",
    r"(?:надати|надіслати|передати)\s+(?:відповідь|телефоном|поштою|письмово|електронн" + W + r"*\s+пошт" + W + "*)",
    r"бажа[єи]\s+отримати",
    r"згоду\s+на\s+оброб" + W + r"*[^.!?]*",
    r"(?:заявни" + W + r"*|заявники)\s+повідомля" + W + "*",
    ASK + MEASURES + r"(?=[.,!?;]|$)",
    r"(?:відповідь\s+(?:заяв" + W + r"*\s*)?|просимо|просить)\s*надати\s+" + MODE,
    r"(?:надати|повідомити|передати)\s+" + MODE,
    r"листом\s+та\s+" + MODE,
    r"(?:і|та)\s+[ву]\s+письмовом" + W + r"*\s*,\s*(?:і|та)\s+" + MODE,
    r"[ву]\s+у?\s*телефонном" + W + r"*\s+режим" + W + r"*\s*,\s*(?:і|та)\s+письмов" + W + "*",
    r"(?:надати|повідомити|передати)\s+(?:відповідь\s+)?заявни(?:ку|ці|кам|цям)\s+" + MODE,
    r"(?:^|(?<=[.;!?]))\s*" + MODE,
    r"(?:^|(?<=[.;!?]))\s*заявни" + W + r"*\s+проси" + W + r"*\s+зв['’]?язатися\s+" + MODE + r"(?:\s+для\s+[^.!?]*)?",
)
#: Every clause dropped holds one of these, so texts without any need no further look.
CLAUSE_STEMS = I + "заяв|відповід|згоду|роз’ясн|нада|надіслати|передати|повідомити|бажа|прохан|прос|прошу|листом|письмов|телефонн"
ANSWER_STUB = I + r"(?:^|(?<=[.;!\s]))\s*відповідь\s*[.!]?\s*"
TRAILING_VERB = I + r"(?:^|(?<=[.;!\s]))\s*(?:та|і|й|або|чи)\s+нада[ти]\s*[.!]?\s*$"
DANGLING_HEAD = I + r"^\s*(?:для|щоб|та|і|й|або|бо|проте)\s+[^.!?]{2,80}[,;:.]?\s*"

ACTION_VERBS = (
    "вжити", "надати", "відновити", "прибрати", "усунути", "відремонтувати", "провести", "замінити", "виконати", "забезпечити", "встановити", "вивезти",
    "перевірити", "вирішити", "зробити", "очистити", "опрацювати", "розглянути",
)
ANY_ACTION_VERB = I + "|".join(ACTION_VERBS)
ACTION_VERB = I + r"^\s*(?:" + "|".join(ACTION_VERBS) + ")" + END
ACTION_MARKER = I + r"^\s*(?:прошу|прохаю|прохання|просимо|просить)\s*(?:щонайменш|найшвидше|негайно|терміново|якомогашвидше)?\s*"
GENERIC_ACTION = I + r"^вжити\s+" + MEASURES + r"[.!]?$"
PURPOSE = I + r"\s+для\s+\S+"

#: Topic repair: who tells, and what a request begins with.
NARRATION = I + r"\s+(?:заявниц\p{L}*|заявник\p{L}*|громадян\p{L}*)\s*[.!?]*$"
REQUEST_LEAD = r"^(?:Прошу|Просимо|Вимагаю|Вимагаємо)[,\s]+"
REQUEST_SENTENCE = r"^(?:Прошу|Просимо|Вимагаю|Вимагаємо)\s+"
REQUEST_MARKER = I + r"(?<!\p{L})(?:прошу|просимо|треба|потрібно|вимага|прохання|звертаю|наголошую)"

#: Personal data in reports.
LIKE_PHONE = r"(?:\+?3\s?8[0-9\s\-(]{8,14}|\b[0-9]{3}[-\s][0-9]{3}[-\s][0-9]{2}[-\s][0-9]{2}\b|\b\d{10}\b)"
LIKE_EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"

KIND_TO_DOMAIN = {
    "Будівництво та ремонт доріг, вулиць": "roads",
    "Будівництво, містобудування, архітектура": "construction",
    "Гаряче та холодне водопостачання": "water",
    "Діяльність органів місцевого самоврядування": "government",
    "Експлуатація та ремонт житла ( у т.ч. ліфтів, сантехнічного обладнання тощо)": "housing",
    "Електропостачання населених пунктів, будинків": "electricity",
    "Питання пов’язані з торгівлею (у тому числі стихійна торгівля)": "commerce",
    "Плата за житло та комунальні послуги ( у т.ч. підвищення тарифів)": "payments",
    "Пільгове перевезення пасажирів": "transport",
    "Робота пасажирського транспорту (у т. ч. електричного транспорту)": "transport",
    "Санітарний стан, благоустрій населених пунктів, прибудинкових територій": "sanitation",
    "Теплопостачання": "heating",
}
