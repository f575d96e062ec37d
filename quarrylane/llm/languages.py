"""The language of a text, from profiles of short character sequences and whole short words.

The profiles are built from the samples below: the first article of the Universal Declaration of
Human Rights and a list of each language's most frequent words. A text's words are scored under each
profile as by naive Bayes; names, figures and words in capitals are left out, since they tell little.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from functools import cache

import numpy as np

#: A sample of each language in Latin or Cyrillic letters.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of and to in is that it for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir kann keine unter gegen vom schon wenn habe seine",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ont aux son cette ou mais comme on tout nous sa fait été aussi leur bien peut ces y deux sans être elle même entre après ses peu leurs lui où je vous si très avant",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. di e il la che in a per un è del non una i le si con da al sono come dei nel alla più anche lo ha della gli su ma delle o se ci essere questo loro due tra stato tutti suo ai dalla ho degli dal nella chi mi sua solo dopo molto quando era hanno fatto prima cui così senza ancora ogni",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. de van een en het in is dat op te zijn met voor niet aan er om ook als dan maar bij door uit naar die hij ze of worden nog over wel wordt meer tot heeft deze kan was al dit hun werd we zo geen tegen hebben veel moet onder wat je daar na twee",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över bara in blir upp även vad få två vill",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. og i at det er en til af på for med den der de ikke som har et han men var jeg sig fra vi så kan når år under også efter eller nu sin hvor ved mod skal ville kommer ud får være havde alle andre meget end her da siden over kun ind bliver op hvad to vil blev sådan nogle",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. og i det er som en på til av for med at den har de ikke om et han men var jeg seg fra vi så kan når år under også etter eller nå sin hvor ved mot skal ville kommer ut får være hadde alle andre mye enn her da siden over bare inn blir opp hva to vil ble noen",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ja on ei että se oli hän mutta ovat kun niin myös kuin tai jos vain joka mukaan sen ole olla nyt sekä vuoden jo ollut hänen voi mitä minä kaikki sitä jotka tämä siitä ennen jälkeen kanssa siellä enemmän koska hyvin vielä yli noin saa",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. w i na z się nie do to że jest o a jak po co od za przez dla są tym ale by czy był jako oraz tak przy tego może ma już tylko jego które który można była roku także jednak bardzo więcej było został będzie pod nad bez jeszcze przed lub ich",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. a v se na je že o s z do i to k ve pro za by ale si po jako od jsou který byl jeho tak až jen také podle která při které co už jsem bude nebo však může má před ani než aby bylo ještě jejich však kde mezi pod roku",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a majú navzájom jednať v bratskom duchu. a v sa na je že o s z do aj to k vo pre za by ale si po ako od sú ktorý bol jeho tak až len tiež podľa ktorá pri ktoré čo už som bude alebo však môže má pred ani než aby bolo ešte ich kde medzi pod roku",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. a az és hogy nem is egy ez meg de azt el van csak volt mint már ki ha még vagy lehet kell mert sem minden után pedig amely nagyon több ezt így fel majd most aki ami között szerint lesz ezek azonban két első",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. de și în a la cu pe nu o că din să se care mai este un pentru au fi ce sau ca fost dar sunt prin după lui ale am doar foarte acest această era poate unei fără între până când cum ei îl le toate cele sale acum",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ve bir bu da için de çok ile en olarak daha olan gibi kadar ne sonra var o ama her ya yeni değil ise göre ki mi iki diye önce olduğu büyük oldu ancak hem kendi şey bile tarafından olduğunu üzerine yok şirket",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. yang dan di itu dengan untuk tidak ini dari dalam akan pada juga saya ke karena tersebut bisa ada mereka lebih kata tahun sudah atau saat oleh menjadi orang ia telah adalah seperti sebagai bahwa dapat para harus namun kita dua satu masih hari hanya kepada",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. và của là có được cho không trong một các với người những để đã này khi từ đến về cũng như ra nhiều phải đó vào năm ở lại nhưng sẽ theo trên tại rất công ty còn làm hơn",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. ja on ei et see oli ta aga kui ka nii või siis mis oma kes ning tema ma olid juba veel seda pole välja selle üle kas mitte kuid pärast ainult rohkem väga",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. un ir ar ka no uz par bet tas arī kas lai to pie pēc kā vai viņš nav bija es jau tikai gan tad līdz vairāk savu šo tā mēs tika",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. ir kad yra į iš su tai kaip ne apie už buvo bet po jis ar tik jo dėl jau labai gali nuo metų iki taip pat kai mes daugiau šio",
    "sl": "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. in je v na se da za so ki pa z s tudi ne ali kot po bi o bil od iz le do še kar pri lahko ko bo ni že ker med samo po zelo leta bilo več",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedno prema drugome postupati u duhu bratstva. i u je na se da za su od s kao ne o ali a koji iz do što sa te nije bio koje po ili može samo još već koja biti kako zbog nakon bi vrlo godine više",
    "sq": "Të gjithë njerëzit lindin të lirë dhe të barabartë në dinjitet dhe në të drejta. Ata kanë arsye dhe ndërgjegje dhe duhet të sillen ndaj njëri-tjetrit me frymë vëllazërimi. e të në dhe për me një nga që është i së si nuk ka janë por kjo ky më do se u këtë tij ose vetëm",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres. de la i el a que en per les els un amb una del no és al es dels més va com ha o si però seva també són aquest molt entre quan fins",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. na ya wa kwa katika ni za la kuwa cha hii kama huo yake pia vya hiyo alisema watu lakini baada sana wakati wake au hata kila",
    "tl": "Ang lahat ng tao'y isinilang na malaya at pantay-pantay sa karangalan at mga karapatan. Sila'y pinagkalooban ng katwiran at budhi at dapat magpalagayan ang isa't isa sa diwa ng pagkakapatiran. ng sa na ang mga ay at siya ito para hindi niya ni may kung si ko pero isang kanyang nila lang din mula bilang",
    "af": "Alle menslike wesens word vry, met gelyke waardigheid en regte, gebore. Hulle het rede en gewete en behoort in die gees van broederskap teenoor mekaar op te tree. die van en in is het dat te vir op met nie wat 'n aan was hy om as sy ook deur by sal uit kan maar word meer na toe daar of hulle baie was",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. и в не на я что он с как это по но из у за к так для от было же о вы бы то только его мы или еще все если может уже после более очень",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. і в не на що я з це він та до як у за але є від по так для його про був ми або ще вже якщо може після більше дуже",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. на и да за от се в не е че с са по като но това ще до има който си към при още или след само може много",
}
#: Scripts that tell a language, or a group of them, by themselves.
SCRIPTS = {
    "el": "Ͱ-Ͽ", "he": "֐-׿", "ar": "؀-ۿ", "hi": "ऀ-ॿ", "bn": "ঀ-৿", "ta": "஀-௿", "th": "฀-๿", "ka": "Ⴀ-ჿ", "hy": "԰-֏", "ko": "가-힯", "ja": "぀-ヿ", "zh": "㐀-鿿",
}
_SCRIPTS = {k: re.compile(f"[{v}]") for k, v in SCRIPTS.items()}
_NOT_LATIN = re.compile("[" + "".join(SCRIPTS.values()) + "Ѐ-ӿ]")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Words that do not begin with a Latin capital.
_SMALL = re.compile(r"(?<![^\W_])[^\W\d_A-Z][^\W\d_]*(?:['’][^\W\d_]+)?")
#: A language is told from this many words on, at this mean advantage over the one expected, in nats a word.
LEAST_WORDS, MARGIN = 4, 0.5
#: Nothing else is looked at where words that only the expected language's sample has are so many times as many as those of any other.
SURE = 8
_SMOOTH = 0.3


def _grams(word: str) -> list[str]:
    w = f" {word} "
    out = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [*out, w] if len(word) <= 5 else out


class Profiles:
    """Scores of words under each language, kept for words met again."""

    def __init__(self):
        self.names = list(SAMPLES)
        counts = {k: Counter(g for w in _WORDS.findall(t.lower()) for g in _grams(w)) for k, t in SAMPLES.items()}
        every = sorted(set().union(*counts.values()))
        self.at = {g: i for i, g in enumerate(every)}
        table = np.array([[counts[k][g] for k in self.names] for g in every], dtype=float) + _SMOOTH
        self.logs = np.log(table / table.sum(axis=0))
        self.unseen = np.log(_SMOOTH / (np.array([sum(counts[k].values()) for k in self.names]) + _SMOOTH * len(every)))
        own = {k: set(_WORDS.findall(t.lower())) for k, t in SAMPLES.items()}
        shared = Counter(w for words in own.values() for w in words)
        self.common = {k: frozenset(w for w in words if shared[w] == 1) for k, words in own.items()}
        self.telling = frozenset().union(*self.common.values())  # each is a word of one language only
        self.held: OrderedDict[str, np.ndarray] = OrderedDict()

    def sure(self, expected: str | None, words: list[str]) -> bool:
        """Whether the words of the expected language outnumber all others' by far."""
        if expected not in self.common:
            return False
        told = list(filter(self.telling.__contains__, words))
        n = sum(map(self.common[expected].__contains__, told))
        return n >= LEAST_WORDS and n >= SURE * (len(told) - n)

    def word(self, w: str) -> np.ndarray:
        v = self.held.get(w)
        if v is None:
            grams = _grams(w)
            v = self.held[w] = sum((self.logs[self.at[g]] if g in self.at else self.unseen for g in grams), np.zeros(len(self.names))) / len(grams) * 4
            if len(self.held) > 50_000:
                self.held.popitem(last=False)
        return v

    def scores(self, words: list[str]) -> np.ndarray:
        """Mean score of the words under each language."""
        return sum((self.word(w) for w in words), np.zeros(len(self.names))) / max(1, len(words))


@cache
def profiles() -> Profiles:
    return Profiles()


def plain_words(text: str) -> list[str]:
    """Words in small letters; where these are few, all words."""
    small = _SMALL.findall(text)
    return small if len(small) >= LEAST_WORDS else [w.lower() for w in _WORDS.findall(text)]


def language(text: str, expected: str | None = None, known_words: list[str] | None = None) -> str | None:
    """The language that most of the text is in; None if too little tells.

    expected: the language that the text should have; another one is only told where it is clearly
    the better, else the expected one is the answer. known_words: the text's words in small letters, if at hand.
    """
    p = profiles()
    # a text with the words that only the expected language has needs no further look
    if p.sure(expected, known_words or text.lower().split()):
        return expected
    if not text.isascii() and len(_NOT_LATIN.findall(text)) >= LEAST_WORDS:
        weights = {k: len(r.findall(text)) * (3 if k in ("zh", "ja", "ko") else 1) for k, r in _SCRIPTS.items()}
        # names and headings may stay Latin
        if sum(weights.values()) > sum(len(w) for w in _SMALL.findall(text) if not _NOT_LATIN.match(w)):
            return "ja" if weights["ja"] * 10 > weights["zh"] + weights["ja"] and weights["ja"] else max(weights, key=weights.__getitem__)
    words = plain_words(text)
    if len(words) < LEAST_WORDS:
        return None
    if p.sure(expected, words):
        return expected
    s = p.scores(words)
    best = int(s.argmax())
    if expected in p.common:
        return p.names[best] if s[best] - s[p.names.index(expected)] > MARGIN else expected
    return p.names[best]
