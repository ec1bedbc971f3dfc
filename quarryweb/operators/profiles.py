"""What tells languages apart: frequent words of each, and its letters outside a-z or its script.

Word lists are the usual function words of each language, written down for this
purpose. SAMPLES is the first sentence or two of the first article of the
Universal Declaration of Human Rights, a public text; it adds to the letters
that follow each other in a language. Codes are those of ISO 639-3.
"""

from __future__ import annotations

#: Languages of the Latin script: frequent words, and letters that they use beside a-z.
LATIN = {
    "eng": ("the of and to in is that for it with as was on are be this by from at or an not have has which you were their but they his her we all there been would will", ""),
    "deu": ("der die und das von zu mit den ist des im dem nicht ein eine als auch auf für sich es an werden aus er wird bei einer um nach wie oder sind noch war haben über", "äöüß"),
    "fra": ("le la de les des et en un une du que est pour qui dans par sur au plus ce il ne pas avec sont son cette ses mais nous vous être été aux leur ont", "éèêàâçùûîïôœë"),
    "spa": ("de la que el en y los del las se con por un una para es al su lo como más pero sus no este esta ha entre cuando muy sin sobre también ser fue hay son", "áéíóúñü"),
    "ita": ("di che il la e per un in una sono della dei con non da del le gli al più come anche nel è si alla lo ha delle questo questa ma ed nella dal i", "àèéìòù"),
    "por": ("de que o a e do da em um para com não uma os no na por as mais dos se ao das foi como mas são ele ela também pelo pela seu sua até isso", "áàâãçéêíóôõú"),
    "nld": ("de het een van en in is dat op te zijn met voor niet aan er om ook als bij door naar uit maar werd heeft worden wordt deze nog dan over hij ze", "ëïé"),
    "swe": ("och att det som en på är av för med till den inte har om ett var jag de så men han vi kan från ska eller när vid efter också där sig mycket", "åäö"),
    "dan": ("og det at en den til er som på de med der for ikke et af har han jeg men var sig fra vi så eller kan skal blev efter meget noget mig hvad af også bliver", "æøå"),
    "nob": ("og det i at en som er på til av for med den de ikke har et jeg men var seg fra vi så eller kan skal ble etter mye noe meg hva av også blir være hun nå", "æøå"),
    "fin": ("ja on ei että se oli hän mutta kun niin kuin myös ovat joka mitä tämä sen olla vain sitä sekä tai jos hänen jo vielä nyt kanssa mukaan ole minä", "äö"),
    "est": ("ja on ei et see oli ta kui aga ka mis kes või oma selle siis nii nagu veel juba pole tema mida ning kuid seda olid ma üks kas välja", "õäöü"),
    "lav": ("un ir ka par ar no uz kas to bet tas lai viņš nav tika kā pie pēc vai gan arī bija es mēs savu tikai šo jau kad viņa vēl", "āčēģīķļņšūž"),
    "lit": ("ir yra kad su iš tai bet į kaip o ar jis buvo nuo per apie dar tik jo jų savo kurie kuris už po labai gali taip ji aš", "ąčęėįšųūž"),
    "pol": ("i w na z do się nie to że jest o jak po ale od za co przez tym był są tak dla czy jego lub oraz może już tego które który być ma", "ąćęłńóśźż"),
    "ces": ("a v se na je že o z do to s i ve jako za ale po by jsem jsou jeho od k nebo které který byl jen také už když pro při podle tak ještě může", "áčďéěíňóřšťúůýž"),
    "slk": ("a v sa na je že o z do to s aj vo ako za ale po by som sú jeho od k alebo ktoré ktorý bol len tiež už keď pre pri podľa tak ešte môže", "áäčďéíĺľňóôŕšťúýž"),
    "slv": ("in je v na se za da z ki so pa s bi ne tudi kot po ali od iz pri še lahko ter bil bila ni kar bo le že samo njegov", "čšž"),
    "hrv": ("i je u na se da za su od s a koji što kao iz o ne li bi ili nije sve po ali samo još bio bila može između također kako tko gdje", "čćđšž"),
    "hun": ("a az és hogy nem is egy ez van volt meg de csak már mint ha még el ki vagy azt ezt nagyon szerint után között kell lehet minden mert ő", "áéíóöőúüű"),
    "ron": ("de și în la a cu nu pe un o din care că mai este pentru se prin sau dar fi sunt au fost lui ce după către acest această unui ale", "ăâîșțşţ"),
    "tur": ("ve bir bu için da de ile olarak çok daha olan gibi en ne ama var kadar sonra o her mi ya ki değil ise kendi olduğu ben göre oldu yeni", "çğıöşüİ"),
    "aze": ("və bir bu üçün da də ilə olan ki kimi ən o nə amma var qədər sonra hər ya deyil isə öz olduğu mən görə oldu yeni onun çox daha", "əçğıöşü"),
    "uzb": ("va bir bu uchun bilan ham u da edi deb emas bo'lgan esa har yoki kerak o'z lekin uning kabi shu keyin bor ular men juda eng qilib oʻz boʻlgan bo'lib", "ʻ"),
    "tuk": ("we bir bu üçin bilen hem ol däl bolan diýip ýa öz emma onuň ýaly şol soň bar olar men has iň edip bolup türkmen her hemme ýok ýyl", "äçňöşüýž"),
    "vie": ("và của là có trong được cho các một không người những với đã này khi để từ như ở đến về cũng tôi ra nhiều năm nó vào hay sẽ rất", "ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"),
    "ind": ("yang dan di dengan untuk dari dalam ini itu tidak pada adalah akan ke oleh juga sebagai ada dapat mereka saya telah atau karena lebih bisa sudah kami anda tersebut", ""),
    "jav": ("lan ing kang saka iki sing iku ana uga marang ora kanthi dadi wong kanggo karo ya kabeh yèn bisa utawa ingkang punika wonten menika déning minangka amarga nanging", "èé"),
    "tgl": ("ang ng sa na mga ay at si ni para kung hindi ito siya ko ka mo may ako nila kanyang upang niya isang lahat o bilang dahil rin", ""),
    "cat": ("de la i que el en a les per un una els amb és del no al com més va ser són però també aquest aquesta seva seu fou dels l'any hi ha", "àçèéíïòóúü"),
    "lat": ("et in est non ad cum ut sed qui quod ex per ab esse sunt si quae atque aut nec enim quam hoc ac etiam eius erat autem quibus", ""),
    "afr": ("die van en in is het 'n dat nie om te vir wat met op hy sy as ek aan was by word ook maar sal kan deur hulle ons uit nog ge", "êëô"),
    "zul": ("ukuthi futhi uma noma kodwa ngoba lapho umuntu abantu kakhulu njengoba lokhu khona kanye ukuba yini manje bonke onke izinto wathi yakhe lelungelo unelungelo ngokuthi kuphela", ""),
    "sna": ("kuti uye kana asi nokuti munhu vanhu zvakanaka ane pane iyi izvi ndiye zvose vose kunyange pamwe kubva nekuti zvinhu iye mumwe nyika kodzero akati chete kwete zvino", ""),
    "aka": ("na no a ne wo sɛ ɛyɛ wɔ nti mu onipa biara nnipa ho anaa yɛ so de firi bɛ nyinaa ɔno nea hwɛ kɔ wɔn ɛno sɛɛ obiara", "ɛɔ"),
    "epo": ("la kaj de en estas al ne por ke kun el li pri mi por sed ĉi tiu kiu oni ili aŭ estis de pli ankaŭ ĝi via ĉiu kiel", "ĉĝĥĵŝŭ"),
}
#: Languages that share another script: frequent words, and letters that the others of the script lack.
SHARED = {
    "Ѐ-ӿ": {
        "rus": ("и в не на что с по это как а но он к из у за от для так же все было только его бы или уже если мы вы её при", "ыэё"),
        "ukr": ("і в не на що з та це як а але він до із у за від для так же все було тільки його б або вже якщо ми ви її при є", "іїєґ"),
        "bel": ("і ў не на што з па гэта як а але ён да у за ад для так жа ўсё было толькі яго б або ўжо калі мы вы яе пры", "ўі"),
        "bul": ("и в не на че с по това как а но той към от за се да е са все беше само го би или вече ако ние вие при съм ще", "ъ"),
        "srp": ("и у не на што са по то као а али он из од за се да је су све било само га би или већ ако ми ви при који није", "ђћјљњџ"),
        "mkd": ("и во не на што со по тоа како а но тој кон од за се да е сите беше само го би или веќе ако ние вие при кој сум ќе", "ѓќѕј"),
    },
    "؀-ۿ": {
        "ara": ("في من على إلى أن هذا التي الذي عن مع لا ما كان هو هي كل قد بعد ذلك كما بين أو لم هذه حتى ثم عند", "ةىأإ"),
        "pes": ("در و به از که این را با است برای آن یک خود تا کرد بر هم نیز می شود شد ها وی ما من او بود اگر", "پچژگ"),
        "urd": ("کے میں کی ہے اور سے کا کو نے کہ یہ پر ہیں اس ایک نہیں بھی تھا وہ کر لیے ہو گیا جو تک ان اپنے", "ٹڈڑںےہ"),
    },
    "֐-׿": {
        "heb": ("של את על הוא לא זה עם כי גם או אם היא אני יש כל אבל היה מה רק יותר אל בין כך", ""),
        "yid": ("און איז די אין פון צו דער דאס נישט מיט אַ אויף האט זיי ער וואס מען ווי דעם אבער זײַן", "ײַאָפֿ"),
    },
    "ऀ-ॿ": {
        "hin": ("के में है की और से का को पर ने यह कि एक हैं भी नहीं हो इस तो कर था लिए वह जो गया या", ""),
        "mar": ("आणि आहे या ते व मध्ये हे की तो आहेत नाही होते त्या हा असे ही होता म्हणून केले साठी एक च्या ला", "ळ"),
        "nep": ("र छ को मा हो का लाई यो पनि ले छन् गर्न भएको तथा एक छैन थियो भने गरेको नेपाल हुन्छ गर्ने बाट", ""),
    },
}
#: Scripts of one language here. Japanese also uses Chinese signs, so its own come first and few of them tell.
ALONE = {
    "jpn": "぀-ヿ", "cmn": "一-鿿", "kor": "가-힯", "ell": "Ͱ-Ͽ", "hye": "԰-֏", "kat": "Ⴀ-ჿ", "ben": "ঀ-৿", "pan": "਀-੿", "guj": "઀-૿", "ori": "଀-୿", "tam": "஀-௿", "tel": "ఀ-౿",
    "kan": "ಀ-೿", "mal": "ഀ-ൿ", "sin": "඀-෿", "tha": "฀-๿", "lao": "຀-໿", "mya": "က-႟", "amh": "ሀ-፿", "khm": "ក-៿",
}
#: One sentence of each language that shares its script.
SAMPLES = {
    "eng": "All human beings are born free and equal in dignity and rights.",
    "deu": "Alle Menschen sind frei und gleich an Würde und Rechten geboren.",
    "fra": "Tous les êtres humains naissent libres et égaux en dignité et en droits.",
    "spa": "Todos los seres humanos nacen libres e iguales en dignidad y derechos.",
    "ita": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti.",
    "por": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos.",
    "nld": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren.",
    "swe": "Alla människor är födda fria och lika i värde och rättigheter.",
    "dan": "Alle mennesker er født frie og lige i værdighed og rettigheder.",
    "nob": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd.",
    "fin": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "est": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt.",
    "lav": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās.",
    "lit": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis.",
    "pol": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "ces": "Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv.",
    "slk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv.",
    "slv": "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice.",
    "hrv": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima.",
    "hun": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
    "ron": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi.",
    "tur": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar.",
    "aze": "Bütün insanlar ləyaqət və hüquqlarına görə azad və bərabər doğulurlar.",
    "uzb": "Barcha odamlar erkin, qadr-qimmat va huquqlarda teng bo'lib tug'iladilar.",
    "tuk": "Hemme adamlar öz mertebesi we hukuklary boýunça deň ýagdaýda dünýä inýärler.",
    "vie": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền.",
    "ind": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama.",
    "jav": "Sabèn uwong kalairaké kanthi mardika lan darbé martabat lan hak-hak kang padha.",
    "tgl": "Ang lahat ng tao ay isinilang na malaya at pantay-pantay sa karangalan at mga karapatan.",
    "cat": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets.",
    "lat": "Omnes homines dignitate et iure liberi et pares nascuntur, rationis et conscientiae participes sunt.",
    "afr": "Alle menslike wesens word vry, met gelyke waardigheid en regte, gebore.",
    "zul": "Bonke abantu bazalwa bekhululekile belingana ngesithunzi nangamalungelo.",
    "sna": "Vanhu vese vanoberekwa vakasununguka uyewo vakaenzana pahunhu nekodzero dzavo.",
    "aka": "Wɔawo adesamma nyinaa sɛ nnipa a wɔwɔ ahofadi. Wɔn nyinaa wɔ nidi ne kyɛfa koro.",
    "epo": "Ĉiuj homoj estas denaske liberaj kaj egalaj laŭ digno kaj rajtoj.",
    "rus": "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "ukr": "Всі люди народжуються вільними і рівними у своїй гідності та правах.",
    "bel": "Усе людзі нараджаюцца свабоднымі і роўнымі ў сваёй годнасці і правах.",
    "bul": "Всички хора се раждат свободни и равни по достойнство и права.",
    "srp": "Сва људска бића рађају се слободна и једнака у достојанству и правима.",
    "mkd": "Сите човечки суштества се раѓаат слободни и еднакви по достоинство и права.",
    "ara": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق.",
    "pes": "تمام افراد بشر آزاد به دنیا می آیند و از لحاظ حیثیت و حقوق با هم برابرند.",
    "urd": "تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔",
    "heb": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם.",
    "yid": "יעדער מענטש ווערט געבוירן פֿרײַ און גלײַך אין כּבֿוד און רעכט.",
    "hin": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है।",
    "mar": "सर्व मानवी व्यक्ति जन्मतः स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत.",
    "nep": "सबै व्यक्तिहरू जन्मजात स्वतन्त्र हुन् ती सबैको समान अधिकार र महत्व छ।",
}
