"""Words of abusive, hateful and sexual language by their part in a passage.

A row is (role, languages, inflection, words), words without case and accents.
Languages: ``*`` in every passage, else ``en``, ``de``, ``fr``: only in passages of
that language, because the word is harmless in another one.  Inflections make the
other forms: ``n`` English noun, ``v`` English verb, ``a`` German adjective, ``f``
French adjective or participle, ``r`` French verb in -er, ``g`` German verb, ``-`` none.  All rows are fixed values.

Roles and what they weigh are explained in :mod:`abuse`.
"""

TERMS = [
    # --- words that insult by themselves
    ("slur", "*", "n", """motherfucker fucker fuckwit fuckface fuckhead fucktard asshole arsehole arsewipe asswipe wanker dickhead shithead shitbag shitface
     scumbag dirtbag douchebag sleazebag scuzzball cunt twat tosser whore slut cocksucker knobhead bellend pillock dumbass dumbfuck dipshit numbnuts skank ratbag"""),
    ("slur", "*", "-", """arschloch arschlocher arschgesicht arschgeige miststuck drecksau drecksack dreckskerl dreckschwein schlampe schlampen hure huren hurensohn
     hurensohne nutte nutten wichser fotze fotzen schweinehund missgeburt missgeburten scheisskerl mistkerl mistvieh mistsau saukerl spasti hackfresse hundesohn"""),
    ("slur", "*", "-", """connard connards connasse connasses salaud salauds salope salopes salopard salopards pute putes encule encules enculee enfoire enfoires
     petasse petasses grognasse pouffiasse trouduc raclure raclures branleur branleurs merdeux merdeuse"""),
    ("slur", "*", "-", """puta putas gilipollas cabron cabrones pendejo pendejos hijueputa malparido stronzo stronza stronzi troia puttana puttane coglione coglioni
     klootzak klootzakken hoer hoeren kutwijf arrombado skurwysyn skurwysyny kurwa kurwy jebany jebana fitta horunge orospu madarchod bhenchod
     сука блядь мудак ублюдок шлюха"""),
    # --- milder words, or words with an innocent sense: they need a target
    ("mild", "*", "n", """idiot moron cretin imbecile halfwit nitwit dimwit simpleton oaf buffoon lowlife numbskull blockhead bonehead airhead nincompoop retard jackass
     bimbo plonker prat wimp"""),
    ("mild", "en", "n", """bastard bitch prick dick fool loser creep jerk twit git berk dunce clown slag hag crone coward degenerate pervert freak psycho lunatic nutter
     tramp harlot trollop hussy scoundrel rogue wretch liar crook disgrace spastic dullard"""),
    ("mild", "de", "-", """idiot idioten vollidiot vollidioten trottel volltrottel depp deppen blodmann dummkopf schwachkopf hohlkopf holzkopf flachzange armleuchter penner
     versager nichtsnutz lump gauner luder flittchen hanswurst taugenichts scheusal widerling hexe schuft halunke feigling kretin waschlappen bastard bastarde
     abschaum idiotin schlappschwanz rotzloffel nulpe dumpfbacke lugner"""),
    ("mild", "fr", "f", "abruti cretin debile batard bouffon bouffonne couillon tocard crapule vaurien feignasse minable attarde mongolien idiot imbecile lopette garce catin trainee"),
    ("mild", "fr", "-", "con cons conne connes andouille menteur menteuse lache sorciere racaille gueux"),
    ("mild", "*", "-", "imbecil idiota cretino deficiente bastardo cobarde eikel otario babaca zorra dupek"),
    # --- animals and dirt: often said of people
    ("beast", "en", "n", "pig rat snake weasel maggot cockroach roach leech parasite worm slug toad rodent vulture jackal skunk mongrel cur animal savage turd louse hyena"),
    ("beast", "en", "-", "swine vermin scum filth dirt shit crap lice trash garbage dung slime pest"),
    ("beast", "de", "-", """schwein schweine sau saue ratte ratten made maden wurm wurmer kakerlake kakerlaken ungeziefer parasit parasiten schmarotzer zecke zecken wanze
     wanzen laus lause dreck mist scheisse vieh gesindel gesocks geschmeiss schlange aas"""),
    ("beast", "fr", "-", """porc porcs cochon cochons rat rats vermine cafard cafards vipere sangsue sangsues parasite parasites ordure ordures dechet dechets fumier merde
     crotte charogne pourriture truie truies"""),
    ("tame", "en", "n", "dog cow sow ass arse donkey mule goat sheep chicken hog whale ape monkey"),
    ("tame", "de", "-", "hund hunde kuh kuhe ziege ziegen esel kamel rindvieh ochse hornochse affe affen gans koter"),
    ("tame", "fr", "-", "chien chiens chienne chiennes vache vaches ane anes mule chevre singe singes guenon dinde bete betes"),
    # --- words that run somebody down
    ("moral", "en", "-", """worthless stupid disgusting brainless spineless lying useless pathetic miserable vile despicable contemptible pitiful wretched cowardly dumb
     idiotic moronic repulsive sickening loathsome treacherous thieving snivelling sniveling mindless gutless shameless"""),
    ("moral", "de", "a", """blod elend verlogen widerlich dumm faul mies nutzlos wertlos erbarmlich ekelhaft hirnlos feig jammerlich verkommen abscheulich saudumm strohdumm
     unfahig armselig"""),
    ("moral", "fr", "f", "stupide minable lache nul debile miserable pourri degoutant hypocrite bidon menteur inutile pitoyable ignoble"),
    ("moral", "*", "-", "estupido estupida inutil asqueroso schifoso vuile"),
    ("looks", "en", "-", "filthy dirty fat ugly greasy rotten sick slimy stinking smelly old"),
    ("looks", "de", "a", "dreckig fett hasslich verdammt schmierig stinkend billig alt versaut"),
    ("looks", "fr", "f", "gros grosse sale pauvre vieux vieille vilain moche"),
    ("much", "en", "-", "absolute total complete utter fucking bloody damned goddamn proper real such little utterly totally completely fuckin"),
    ("much", "de", "a", "komplett vollig absolut total echt klein richtig gottverdammt"),
    ("much", "fr", "f", "vrai fini putain foutu sacre parfait petit"),
    # --- harm
    ("harm", "en", "v", "kill murder strangle stab drown throttle butcher behead lynch castrate slaughter cripple rape skin gut"),
    ("harm", "en", "-", "shoot shot hang hanged slit shooting hanging gas gassed"),
    ("hurt", "en", "v", "burn smash beat crush bash kick punch whip hurt bury hunt thrash batter flog"),
    ("hurt", "en", "-", "break cut hit breaking cutting hitting knife"),
    ("harm", "de", "-", """umbringe umbringen bringe totschlage totschlagen tote toten erschiesse erschiessen erstechen ersteche erwurge erwurgen absteche abstechen aufschlitzen
     schlitze steche hange aufhangen erschlagen erschlage kill kalle kaltmachen"""),
    ("hurt", "de", "-", """schlage schlagen breche brechen haue hauen trete treten prugle prugeln verprugeln zunde zunden anzunden anzunde reisse reissen schneide schneiden ramme rammen
     mache machen poliere stosse"""),
    ("harm", "fr", "r", "tuer buter egorger etrangler massacrer noyer crever saigner fusiller flinguer assassiner"),
    ("harm", "fr", "-", "pendre pendrai"),
    ("hurt", "fr", "r", "casser frapper bruler defoncer exploser ecraser cogner peter arracher"),
    ("hurt", "fr", "-", "demolir demolirai battre battrai mettrai mettre"),
    ("flesh", "*", "-", """neck teeth tooth legs leg arm arms bones bone face throat head skull jaw fingers kneecaps knees guts nose eyes ribs hals zahne zahn knochen beine bein arme
     gesicht kehle kopf schadel kiefer finger nase augen rippen fresse dents dent jambes jambe bras os visage gorge tete crane machoire doigts nez yeux gueule"""),
    ("home", "*", "-", "house home car shop barn down haus hutte auto laden hof maison voiture baraque boutique feu"),
    ("die", "en", "-", "die dies rot choke suffer bleed starve perish drown burn hang dead hanged jump jumped drowned crash"),
    ("die", "de", "-", "stirb stirbst sterben verreck verrecke verreckst verrecken krepier krepieren krepierst erstickst verrottest springst springen"),
    ("die", "fr", "-", "creve creves crever creveras meurs mourir mourras souffres pourrir pourrisses souffrir"),
    ("wish", "*", "-", "hope wish hoffe hoffentlich wunsche espere souhaite wishes hoped"),
    ("nobody", "*", "-", "nobody noone none niemand keiner keine personne nadie"),
    ("miss", "*", "-", "miss mourn weep cry grieve vermissen vermisst nachweinen nachtrauern betrauern pleurerait pleurera regretterait regrettera regrettent regretter manques"),
    ("live", "*", "-", """live lives sleep sleeps work works school park parks wohnst wohnt wohnen schlafst schlaft schlafen arbeitest arbeitet habites habite habitent dort dorment dors
     vis vit vivent travailles travaille"""),
    ("know", "*", "-", "know knows weiss wissen sais savons"),
    ("alive", "*", "-", "alive breathing walking around living born birth breathe lebst atmest existierst geboren vis vives vivre respires naitre existes exist"),
    ("shame", "*", "-", "ashamed shame pity disgrace schamt schamen schame schande honte dommage"),
    ("favour", "*", "-", "favour favor gefallen service"),
    ("deserve", "*", "-", "deserve deserves deserved verdienst verdient merites merite meriterais meritez"),
    ("punish", "*", "-", "bullet beating noose flogging whipping thrashing kugel strick prugel balle corde raclee shot hanged beaten killed raped whipped burnt burned gassed"),
    ("self", "*", "-", "yourself yourselves"),
    # --- groups of people
    ("group", "en", "n", """immigrant migrant refugee foreigner gypsy traveller jew muslim moslem arab african gay homosexual lesbian transsexual cripple negro turk roma hindu sikh pakistani
     mexican tinker pauper beggar catholic protestant"""),
    ("group", "en", "-", "women disabled blacks queers handicapped poles asians"),
    ("group", "de", "-", """auslander fluchtlinge fluchtlingen migranten asylanten juden moslems muslime araber turken zigeuner schwule schwulen homosexuelle lesben behinderte behinderten
     kruppel weiber frauen schwarze schwarzen polen russen roma sinti"""),
    ("group", "fr", "-", """immigres migrants refugies etrangers juifs musulmans arabes noirs gitans tsiganes roms homosexuels gays lesbiennes handicapes infirmes femmes turcs
     africains"""),
    ("folk", "*", "-", "people families family folk men tribe lot bunch race kind leute menschen familien volk pack gens familles bande"),
    ("slang", "*", "n", "nigger kike wetback chink gook raghead towelhead faggot poofter tranny gyppo pikey"),
    ("slang", "*", "-", "kanake kanaken schwuchtel schwuchteln schlitzauge schlitzaugen negerpack zigeunerpack judensau bougnoule bougnoules youpin youpins tapette tapettes tarlouze pede pedes gouine gouines maricon maricones frocio froci"),
    ("low", "en", "n", "subhuman bloodsucker barbarian ape degenerate"),
    ("low", "en", "-", "plague cancer disease burden vermin filth scum animals beasts savages rats cockroaches parasites maggots pigs dirt rodents insects lice dogs monkeys worms"),
    ("low", "de", "-", "untermensch untermenschen tiere plage pest seuche krebsgeschwur ungeziefer abschaum parasiten dreck schmarotzer ratten kakerlaken vieh affen blutsauger"),
    ("low", "fr", "-", "animaux plaie peste fleau cancer parasites vermine rats cafards dechets racaille betes sauvages singes sangsues"),
    ("crime", "*", "-", """criminals thieves liars rapists murderers crooks cheats scroungers criminal diebe lugner verbrecher vergewaltiger betruger stehlen voleurs menteurs criminels
     violeurs assassins voleur"""),
    ("purge", "en", "-", "exterminated eradicated gassed culled slaughtered butchered lynched castrated sterilised sterilized annihilated purged hunted wiped drowned shot hanged burned burnt"),
    ("purge", "de", "-", "ausgerottet vernichtet vergast erschossen erschlagen ausgemerzt aufgehangt verbrannt ertrankt abgeknallt ausrotten vernichten vergasen erschiessen"),
    ("purge", "fr", "-", "exterminer eliminer abattre tuer gazer pendre bruler noyer fusiller exterminez abattez"),
    ("expel", "*", "-", "deported expelled driven removed abgeschoben vertrieben vertreiben abschieben expulser chasser jeter raus dehors send back put rounded locked"),
    ("ought", "*", "-", "should must ought deserve need needs gehoren gehort mussen muss sollte sollten musste mussten faut faudrait doivent devraient"),
    ("breed", "*", "-", """breed breeds breeding multiply multiplying reproduce reproducing spread spreading vermehren vermehrt reproduisent multiplient pullulent grouillent pullulen"""),
    ("swarm", "*", "-", """rats rabbits roaches cockroaches vermin flies insects lice rodents animals ratten kaninchen karnickel kakerlaken ungeziefer fliegen lause lapins cafards mouches
     poux betes animaux vermine"""),
    ("taint", "*", "-", "stink stinks stank disease diseases poison blood stinken blut sang puent"),
    ("place", "*", "-", "street town village country school schools neighbourhood house city club land strasse dorf stadt rue ville pays club"),
    ("pen", "*", "-", "cage cages gutter sty zoo sewer sewers camp camps oven ovens kennel kitchen jungle swamp box coffin hole desert gosse zoo lager ofen kafig camp cage egout four"),
    ("prey", "*", "-", "mice rat rats weed weeds insects pests rodents moth moths beetles hens horses cattle birds rabbits foxes sheep mause schadlinge ratten kakerlaken souris rats nuisibles"),
    # --- sexual words
    ("crude", "*", "n", "blowjob handjob rimjob gangbang cumshot titty clit threesome"),
    ("crude", "*", "v", "wank titfuck buttfuck fingerfuck deepthroat"),
    ("crude", "*", "-", """ficken fickt fickte gefickt fickst durchficken durchgefickt durchvogeln bumsen gebumst titten muschi mose votze wichsen wichste gewichst abspritzen nichons branlette branler branlait
     enculer niquer couilles follar follarte scopare scoparti pompino fica neuken neukt"""),
    ("lewd", "en", "n", "cock dick prick pussy tit boob knob butt cunt ass arse ball"),
    ("lewd", "en", "-", "horny cum cums cumming screwing shagging banging shagged screwed shag humping fucking fucked fuck fucks"),
    ("lewd", "de", "-", "schwanz schwanzes eier mopse vogeln blasen lutschen lutscht geil geile geiler arsch busen nippel fotze"),
    ("lewd", "fr", "-", "bite bites queue verge chatte cul baiser baise sauter bander bandait suce sucer pipe tringler fourrer zob gland"),
    ("part", "en", "n", "penis vagina vulva breast nipple buttock thigh crotch groin genital testicle erection orgasm"),
    ("part", "en", "-", "naked nude knickers panties bra underwear semen penises"),
    ("part", "de", "-", "penis penises glied gliedes scheide brust bruste brusten schenkel schenkeln hintern nackt nackte nackten unterhose hoschen"),
    ("part", "fr", "-", "penis vagin sein seins cuisse cuisses fesses fesse sexe nu nue nus nues culotte sperme tetons"),
    ("limb", "*", "-", "legs mouth tongue lips hips behind mund zunge beine beinen jambes bouche langue derriere throat hinten"),
    ("act", "en", "v", "lick suck stroke fondle grope caress rub thrust moan mount penetrate undress strip finger spank pound straddle"),
    ("act", "de", "g", "lecken lutschen stohnen spritzen streicheln reiben stossen"),
    ("act", "de", "-", "stiess lutsch leck blas nehmen rieb"),
    ("act", "fr", "r", "lecher caresser penetrer deshabiller"),
    ("act", "fr", "-", "sucait gemir gemissait gemit mouillee prendre"),
    ("solo", "en", "v", "masturbate ejaculate"),
    ("solo", "*", "r", "masturber ejaculer"),
    ("solo", "*", "g", "masturbieren onanieren ejakulieren"),
    ("hint", "*", "-", "came spread ride riding rode slid begged push pushed touch bend kiss slide steckte beugen bucken gleiten prise prendre between zwischen entre shove stick inside"),
    ("hint", "fr", "r", "glisser fourrer toucher"),
    ("firm", "*", "-", "hard stiff erect throbbing swollen wet dripping tight huge steif steifen steifes steifer feucht nass nasse nassen dur dure raide mouillee stiffening"),
    ("bare", "*", "-", "clothes bra knickers panties underwear trousers pants blouse dress skirt shirt kleider hose bluse hoschen vetements culotte robe pantalon"),
    ("ask", "*", "-", "show send zeig zeige zeigen schick schicke montre montrez envoie envoyez"),
    ("lust", "*", "-", "want wanted wanna wants wollte wolle will voulait veux voudrais quiero allait vais would"),
    # --- sober company: clinic, court, farm
    ("clinic", "*", "-", """doctor doctors nurse surgeon surgery hospital clinic patient patients medical examined examination diagnosis infection cancer screening treated tumour lump wound injury
     gynaecologist urologist operation arzt arztin klinik patientin patient untersucht untersuchung operiert medecin chirurgien hopital patiente examine examen"""),
    ("court", "*", "-", """charged count indictment prosecution alleged allegation convicted conviction offence acquitted complaint assault rape anklage angeklagt verurteilt vorwurf accusation
     condamne poursuivi plainte"""),
]

#: Heads of German compounds that insult: a longer word that ends in one is of the same role.
COMPOUND_HEADS = {"slur": "arschloch schlampe schlampen hure huren wichser fotze hurensohn nutte", "mild": "idiot idioten trottel pfosten depp kopf"}
#: Compounds of "kopf" and the like count only with one of these first parts.
COMPOUND_FIRSTS = "voll ober dorf riesen scheiss dumm hohl flach saft matsch quadrat schwach drecks mist sau arsch voll stroh hol erz"

#: (category, weight, words in a row); ``|`` separates choices.
IDIOMS = [
    ("abusive", 1.0, """fuck you; fuck off; fuck yourself; screw you; go to hell; rot in hell; burn in hell; piss off; drop dead; eat shit; kiss my ass|arse; shut your mouth|trap|face;
     shut your filthy|fat|stupid|ugly mouth|trap|face; go hang|drown|kill|fuck yourself; watch your back; son of a bitch|whore; sons of bitches; piece|pieces of shit|filth|scum|trash; waste of space|oxygen|skin;
     get lost you; up your|her|his arse|ass; dead man walking; you re dead; you are dead meat; rot you; bugger off; sod off"""),
    ("abusive", 1.0, """verpiss dich; verpisst euch; fick dich; fickt euch; leck mich; halt die|deine fresse|schnauze|klappe; halt dein maul; halt dein dreckiges maul; halts maul; haltet die fresse; geh sterben; geh doch sterben;
     fahr zur holle; zur holle mit; verrecke doch; verreck doch; verrecke endlich; stuck dreck|scheisse|mist; haufen dreck|scheisse; du kannst mich mal"""),
    ("abusive", 1.0, """ta gueule; vos gueules; ferme ta gueule; ferme la; fermez vos gueules; va te faire foutre|enculer|pendre|voir; va crever; va mourir; va au diable; va chier; nique ta mere|race; je t emmerde; je vous emmerde; casse toi;
     fils de pute|chien|putain; fille de pute; tas de merde|fumier; sac a merde; trou du cul; tete de noeud|con; espece de merde; allez crever"""),
    ("abusive", 1.0, "hijo de puta|perra; hija de puta; vete a la mierda; que te jodan; filho da puta; figlio di puttana; va fan culo; vai a cagare; spierdalaj; idz w chuj; sik tir"),
    ("hateful", 1.0, "go back to the jungle|desert|swamp|bush; back to where they|you came; in their blood; born criminal|criminals; liegt ihnen im blut; im blut; dans le sang; vermin race; master race"),
    ("sexual", 1.0, "jerked|jerking|jerk off; jacked|jacking|jack off; sucked|sucking|suck him|me|it off; bend over and; tailler une pipe; taille une pipe; einen blasen|runterholen; von hinten nehmen"),
]

#: (terms, words of the same sentence that show their innocent sense).
SENSES = [
    ("bastard bastards", "file rasp wedlock born sword wing title statute descent child saw"),
    ("bitch bitches", "spaniel whelped whelp kennel breed registered litter terrier hound puppies pups"),
    ("dog dogs ass arse donkey cow sow goat mule sheep hog chicken ape monkey", "breed bred kennel strayed stray pack spaniel stable market herd farm farmer owner leash vet veterinary zoo animal milk rule law"),
    ("pig pigs swine animal animals snake toad worm worms slug weasel", "breed bred strayed prize farm farmer market herd sty crop stable sold vet veterinary slaughtered zoo kept"),
    ("vermin rat rats cockroach cockroaches roach roaches maggot maggots leech leeches parasite parasites louse lice vulture", "mice crop sprayed namely spoiled infection diagnosis granary harvest cellar intestine horse trap traps poison meat"),
    ("cock cocks", "hen hens rooster aviary stopcock ball valve cistern tap poultry crowed fighting bird"),
    ("dick dicks", "mr moby surname christian tracy"),
    ("prick pricks", "needle finger pin skin thorn"),
    ("pussy", "cat cats willow kitten"),
    ("tit tits", "blue great coal nest nested bird birds nests feeder"),
    ("ball balls", "tennis cricket billiard bearing bearings golf valve foot football cannon game"),
    ("fucked fucking", "up"),
    ("shit dirt filth trash garbage dung crap scum slime pest", "spoiled removed brush cleaned sewage collected bin drain surface pond boiler control"),
    ("idiot idiots imbecile imbeciles cretin cretins moron morons lunatic lunatics", "act acts statute lunacy asylum novel film play book author ballet opera deficiency guardian"),
    ("retard retards", "flame growth setting spread fire spark ignition coating"),
    ("faggot faggots", "peas gravy wood bundle bundles sticks menu firewood"),
    ("slag", "heap furnace iron ore mine"),
    ("whore whores slut sluts", "street lane parish babylon"),
    ("screw screwed screwing", "bolt nut bolts wood driver thread metal plate"),
    ("coward fool freak crook rogue jerk creep liar", "noel feast april wave weather"),
    ("schwein schweine sau saue kuh kuhe ziege esel hund hunde rind rindvieh kamel affe affen gans ochse vieh", "pferdes operation tierarzt geschlachtet stall markt zucht herde schlachthof schaferhund halter leine futter"),
    ("ungeziefer parasit parasiten made maden zecke zecken wanze wanzen ratte ratten dreck mist laus lause wurm wurmer kakerlake kakerlaken", "kuhlhaus verdorben stall keller befall kammerjager lager acker darm ernte"),
    ("schwanz schwanzes", "pferdes hundes katze tier operation gelahmt fell"),
    ("eier", "huhner korb karton gekocht"),
    ("vogeln", "den von mit nest"),
    ("cochon cochons porc porcs chien chiens chienne chiennes rat rats vermine cafard cafards charogne vache vaches truie mule ane", "cheval veterinaire marchandises photographie ferme elevage marche voisin laisse recolte cave grange petits mordu"),
    ("ordure ordures dechet dechets fumier", "menageres collecte ramassees champ bac lundi poubelle"),
    ("batard batards", "baguette boulangerie pain"),
    ("chatte", "petits grange chat chats veterinaire souris"),
    ("bite bites", "dog insect mosquito chien"),
    ("queue", "file attente cheval billard gens"),
    ("baiser", "un recu mere joue main front"),
    ("crude clit", ""),
    ("con conne cons", ""),
]

#: Ways to die that a favour may consist in.
ENDS = "train bridge cliff roof rope breathing disappear bus".split()
#: Plural verbs before which an unknown name is a kind of people.
KIND_VERBS = "breed belong stink spread should must are have run steal multiply sind gehoren vermehren mussen sont doivent stinken".split()
#: Objects of crude verbs.
PARTNERS = "women woman girl girls men man boys wife wives secretary maid maids nurse frau frauen madchen femme femmes fille filles".split()
#: What follows "people of that".
KINDS = "faith colour color sort kind race religion tribe creed blood".split()
#: Second persons.
YOU = """you your yours yourself yourselves youre ya u ur du dich dir dein deine deiner deinen deinem deines euch euer eure tu toi te ton ta tes vous votre vos eres sei jij jou jouw ty usted ti""".split()
#: Nouns before which "ihr" is "her"; before all others it is the plural "you".
HERS = "schwein hund esel parasit rindvieh kamel ungeziefer dreck mist wurm vieh affe ochse abschaum lump idiot trottel".split()
FIRST = "i we ich wir je j nous on ill im".split()
THEM = "him her them ihn ihm sie le la les lui".split()
THIRD = "he she they er sie il elle ils elles who that judge lawyer clerk neighbour richter anwalt nachbar juge avocat voisin".split()
BE = "is are re was were am be been being ist sind bist seid war waren bin sei est sont es etes etait sera suis sois eres es s".split()
#: Words that may stand between an address and its noun.
FILLERS = "a an the nothing but just only all such so really doch nur nichts als ein eine einen einem so denn ja ne n qu que un une des de d le la and or und et y e un una uno of always still bloody too zu sont".split()
SAYING = """said say says saying told tells shouted shouting shouts wrote written writes write called calls replied answered answers recalled recalls reads read stated screamed yelled whispered muttered
texted posted quoted according words message remark added sagte schrieb schreibt schrie rief nannte antwortete lautete stand vermerkt wortlaut dit ecrit ecrivait crie rapporte repondu lit redige traite mots""".split()
NAMING = "called calls calling nannte nannten genannt beschimpfte beschimpft traite traita traitait".split()
KNOWN_BY_ALL = "everyone everybody always jeder jeder alle monde toujours immer".split()
MOTHERS = "mother father brother sister son daughter wife husband family mutter vater bruder schwester sohn tochter frau mann mere pere frere soeur fils fille".split()
NOT = "not never no nicht nie kein pas jamais".split()
ALL = "those these all every any the diese die alle ces les tous toutes jeder".split()
WILL = "will ll shall going gonna werde werden wird vais va allons voy".split()

#: Frequent small words that tell the language of a passage.
SMALL = {
    "en": "the of and to in that is was for on you your i he she with at by it his her a an are my would who they all this not me be".split(),
    "de": "der die das und ist ein eine zu den dem nicht mit du dich ich er sie auf von im dir wie wo ihr sind wir dein deine diese so hat".split(),
    "fr": "le la les de et un une des est que je tu il elle ne pas du au ce ces sur dans vous te ta ma sont qui en d l qu ton mon sa".split(),
}

#: Words without a weighty role of their own that may carry a passage.
STARTS = """dead mort morte morts toter totes tote better besser mieux knows belong belongs gehoren gehorst gehort raus dehors deported expelled abgeschoben expulser
inside spread gas hire employ serve rent vermietet vermieten bedienen embauchons louons street village school schools people leute menschen gens hommes""".split()
STARTS_OF_GROUPS = frozenset("dead mort morte morts toter totes tote belong belongs gehoren gehort no keine kein hire employ serve rent vermietet vermieten bedienen embauchons louons burn gas subhuman subhumans send throw ship".split())
#: Words of idioms that are too common to carry a passage.
WEAK_STARTS = "up off it me him back out came come where they her his die do go get la mit and mere race yourself mouth face trap man".split()
