"""Words and rules of abusive language in four languages. Fixed values, kept apart from the scorer.

A word list is a class; its words are matched with their misspellings. A rule is
a weight and an ordered pattern: words, words joined by |, or @CLASS, each at
most so many words after the one before. Weight 1 alone makes a document a case.
"""

from __future__ import annotations

CLASSES: dict[str, str] = {
    # Nouns that degrade a person.
    "INSULT": """
        idiot moron imbecile cretin asshole arsehole dumbass jackass bastard scumbag shithead dickhead fuckhead loser pig swine
        shitbag douchebag wanker bitch whore slut cunt retard halfwit dimwit nitwit pisshead motherfucker cocksucker fucktard
        scum lowlife degenerate parasite twat prick tosser faggot simpleton maggot cockroach buffoon muppet dunce numpty bellend
        knobhead shitstain sleazebag scoundrel weasel imbecilic dipshit bonehead blockhead douche jerkoff crackhead gobshite
        idiots morons imbeciles cretins assholes dumbasses bastards scumbags shitheads losers bitches whores retards dickheads
        motherfuckers cocksuckers wankers sluts cunts faggots buffoons muppets dunces twats pricks tossers maggots halfwits
        vollidiot schwachkopf arschloch dummkopf wichser hurensohn missgeburt drecksau schlampe fotze hure schweinehund
        vollpfosten trottel penner spast mistkerl dreckskerl idioten arschlöcher depp volltrottel miststück
        connard connasse imbecile abruti encule salope salaud batard crétin debile pute enfoiré ordure cons connards salopes
        idiota imbecil gilipollas cabron pendejo estupido subnormal maricon zorra puta capullo cretino retrasado idiotas imbeciles
    """,
    # Of these, words for a person that have no other use: enough alone.
    "SWEAR": """
        asshole arsehole motherfucker cocksucker dickhead fuckhead shithead scumbag wanker cunt fucktard dipshit motherfuckers
        assholes wankers dickheads arschloch hurensohn wichser drecksau fotze missgeburt connard enculé salope gilipollas hijueputa
    """,
    # Nouns of abuse without a second sense: enough where a person is spoken of.
    "STRONG": """
        idiot moron imbecile cretin dumbass jackass bastard scumbag shithead dickhead loser wanker bitch whore slut cunt retard halfwit
        dimwit nitwit degenerate twat prick tosser idiots morons imbeciles cretins bastards scumbags losers bitches whores retards
        vollidiot schwachkopf trottel schlampe drecksau connard abruti imbécile salope gilipollas pendejo imbécil cabrón
    """,
    "ADJ": """
        stinking filthy spineless worthless useless pathetic disgusting miserable braindead goddamn goddamned stupid dumb
        fucking bloody brainless ugly dirty rotten lousy retarded vile repulsive wretched typical cretinous moronic idiotic
        clueless gormless incompetent absolute complete utter total
        dummer dumme verdammter verdammte blöder blöde dreckiger dreckige widerlicher erbärmlicher nutzloser mieser
        pauvre sale inutile espece gros stupide
        pedazo maldito maldita asqueroso inutil puto sucio
    """,
    # Creatures and things people are likened to; an insult beside YOU or an adjective of abuse.
    "BEAST": "donkey rat rats clown ape cow dog swine pig pigs animal animals schwein cerdo burro",
    "YOU": "you your youre yourself u ya thou ur du dich dir dein deine deinen bist ihr euch tu te toi ta vous votre eres tu ti tus te",
    # Groups of people.
    "GROUP": """
        immigrants foreigners refugees migrants gays lesbians homosexuals women girls northerners southerners race religion disabled
        cripples jews muslims christians blacks whites asians arabs gypsies valley oldpeople poor peasants natives queers transgender
        africans mexicans catholics hindus sikhs albanians romanians turks russians chinese indians pakistanis kurds serbs
        ausländer frauen flüchtlinge juden muslime schwule behinderte zigeuner migranten schwarze türken
        étrangers femmes immigrés juifs musulmans arabes réfugiés homosexuels handicapés noirs migrants
        extranjeros mujeres inmigrantes judios musulmanes gitanos refugiados homosexuales negros moros migrantes
    """,
    "ONE": "muslim jew arab gypsy immigrant foreigner migrant refugee gay lesbian african mexican turk pole cripple homosexual ausländer jude moro negro juif arabe",
    "FILTH": "filthy dirty stinking fucking disgusting vile goddamn bloody dreckige sale sucio sucios sales",
    # With PEOPLE after it such a word names a group.
    "TRAIT": "old black brown white poor gay trans disabled jewish muslim foreign northern southern valley asian arab fat alte behinderte vieux noirs viejos",
    "PEOPLE": "people folk folks men kids families students ones leute menschen gens gente",
    # Words that are nothing but hatred of a group.
    "SLUR": "raghead ragheads towelhead towelheads kike kikes nigger niggers wetback wetbacks tranny trannies kanake kanaken bougnoule bougnoules youpin sudaca sudacas",
    # What hate speech says of groups: enough alone, or enough as two.
    "HATE": """
        vermin subhuman subhumans untermenschen exterminate exterminated sterilise sterilize sterilised eradicate gassed deported
        wiped inferior parasites cockroaches ungeziefer abschaum untermensch vergasen ausrotten vermine cafards sous-hommes
        exterminer ratas basura alimañas escoria exterminar infrahumanos lynch lynched scum
    """,
    "HATEISH": """
        rats breed criminals liars thieves kitchen gutter stupid ban burn burned lock locked blood filth disease animals hate despise
        kick kicked shoot hang deserve die clean subhuman leeches invaders plague dirty lazy spat stink ruin throw
        verbrecher lügner diebe küche gosse herd dumm blöd raus weg brennen abschieben hassen dreck faul
        bêtes chasse chasser dehors cuisine voleurs menteurs criminels brûler haine sales expulser
        echarlos fuera cocina ladrones criminales mentirosos quemar odio sucios inutiles sirven
    """,
    # Crimes a whole group is said to live by.
    "CRIMES": "thieves criminals liars rapists terrorists parasites vermin subhuman cockroaches scum murderers verbrecher diebe voleurs ladrones",
    # Doing harm to a body.
    "HARM": """
        kill murder stab strangle slaughter rape gut slit smash choke punch shoot beat break cut burn hang hunt bury hurt crush cripple
        töten umbringen abstechen erschießen erschlage breche schlage tuer buter casser crever égorger frapper briser
        matar matarte romper romperte partir partirte degollar
    """,
    # The same said of one who suffers it.
    "HARMED": "beaten shot hanged killed burned raped stabbed gassed lynched executed drowned beheaded strangled erschossen vergast",
    "BODY": """
        throat neck skull head face teeth legs arms fingers finger bones bone jaw knees ribs eyes nose
        zähne finger knochen beine gesicht schädel hals doigts jambes os dents gueule crâne dedos piernas huesos cara cabeza cuello
    """,
    "OWN": "your his her their every yer dir ihm les los las la tu ton ta vos the",
    "DEATH": "choke chokes die dies dead suffer suffers rot rots cancer drown krepier verrecke verrecken crève muérete murieras",
    # What people of sense can do.
    "ABILITY": "breathe live read count code think understand write learn spell program exist",
    "CANNOT": "cannot cant couldnt can't couldn't unable",
    # Explicit words, and words that are explicit in company.
    "SEXUAL": """
        pussy tits titties cock dick fucking fuck fucked fucks porn porno horny blowjob handjob cumshot gangbang milf milfs nudes panties
        boobs clit dildo orgasm masturbate masturbating xxx threesome deepthroat creampie anal cunnilingus whores sluts camgirl
        titten nacktbilder ficken gefickt fickt muschi schwanz geil geile wichsen blasen möse
        baiser baise bite chatte seins nichons sucer branler cul partouze
        tetas follar follara folla polla pollas culo mamada desnuda pajas corrida
    """,
    "SEXISH": """
        naked nude moaned moaning thighs stripping strip hardcore sex sexy lick licking wet hard cam cams wives escorts bed undressed
        undress nipples kissed bend scream screamed begged bedroom lust girls hot ride rode came night mouth suck
        nackt ausziehen auszog stöhnte schenkel nackte
        nue nues déshabilla déshabille gémit cuisses nuit suce
        desnudo desnudas gimió muslos desnudó ropa quitó chúpame
    """,
    # Explicit words without a second sense: enough alone.
    "EXPLICIT": """
        porn porno masturbate masturbates masturbating blowjob handjob cumshot gangbang deepthroat creampie milf milfs camgirl
        ficken gefickt wichsen nacktbilder follar follara follarte mamada pajas partouze branler nichons
    """,
    # Bodies, and what is asked of them.
    "FLESH": "ass arse tits boobs pussy cock dick nudes titten muschi brüste seins nichons fesses bite thighs nipples tetas culo polla nacktbilder",
    "ASK": "send show want see lick taste touch suck ride fuck thinking dreaming bend schick schicke zeig will envoie montre veux mándame enséñame quiero chúpame suce",
    # Speaking about such language, not in it.
    "META": """
        lexicon lexikon blocklist blacklist wordlist moderation moderator classifier classify label labels labelled toxic toxicity
        task detector dataset corpus annotated annotation annotators recall precision flags flagged flag comments comment removed
        filter filters filtered profanity slur slurs speech insult insults abusive offensive counted survey list lists
        stands means example examples token tokens train trained word words scores codebook census questionnaire censored
    """,
    # Persons a sentence may speak of.
    "PERSON": "partner reviewer maintainer lead author guy whoever everyone everybody ta teacher colleague coworker student professor intern boss manager he she him her they them man woman person",
    # Words that tell a bystander's fault from a person's: an insult addressed to one.
    "WILL": "will going gonna gotta swear ill i'll should would must hope wish want werde ich vais je voy te wanna",
}

#: (weight, greatest step between words, pattern, kind)
RULES: tuple[tuple[float, int, str, str], ...] = (
    # insults
    (1.0, 4, "@YOU @INSULT", "insult"),
    (1.0, 1, "@SWEAR", "insult"),
    (1.0, 2, "@INSULT @YOU", "insult"),
    (1.0, 6, "@YOU @STRONG", "insult"),
    (1.0, 8, "@PERSON @STRONG", "insult"),
    (1.0, 2, "lost|off|mouth|fuck|shut @STRONG", "insult"),
    (0.7, 2, "get lost|stuffed|bent", "insult"),
    (0.7, 3, "shut your|ya mouth|face|trap|gob", "insult"),
    (1.0, 2, "du schwein|hund|esel|affe|sau", "insult"),
    (1.0, 3, "you|du|tu|eres|bist @ADJ @BEAST", "insult"),
    (1.0, 2, "you @BEAST", "insult"),
    (1.0, 2, "dumber|stupider than", "insult"),
    (1.0, 3, "retarded|stupid|dumb|worthless as you|dirt|brick|rock", "insult"),
    (1.0, 2, "@ADJ @INSULT", "insult"),
    (1.0, 3, "@PERSON is|are|was a @ADJ @BEAST", "insult"),
    (1.0, 2, "@INSULT @ADJ nobody|asked", "insult"),
    (1.0, 2, "dear|typical|only|what|by|such|espece|pauvre|pedazo @INSULT", "insult"),
    (1.0, 3, "kind|sort of @INSULT", "insult"),
    (1.0, 3, "piece|sack|pile|bag of shit|crap", "insult"),
    (1.0, 3, "@PERSON is|are|was a|an|such|complete @INSULT", "insult"),
    (1.0, 4, "@PERSON is|are|was a|an @ADJ @INSULT", "insult"),
    (0.8, 3, "is|are a|an @INSULT", "insult"),
    (1.0, 3, "@INSULT learn|learns|nobody|can|should|who|commits|wrote|writes", "insult"),
    (1.0, 2, "@INSULT resign|leave|quit|go", "insult"),
    (0.7, 3, "@ADJ @ADJ", "insult"),
    (1.0, 3, "you|your @ADJ excuse|waste|piece", "insult"),
    (1.0, 3, "excuse for a human|person|man|programmer", "insult"),
    (0.7, 3, "learn to read", "insult"),
    (1.0, 3, "fuck you|off|yourself|them|him|her|u", "insult"),
    (1.0, 2, "piss off", "insult"),
    (0.6, 2, "shut up", "insult"),
    (0.7, 3, "go to hell", "insult"),
    (0.5, 3, "rot in hell", "insult"),
    (1.0, 3, "shove|stick|shoved up your arse|ass", "insult"),
    (0.8, 3, "up your arse|ass", "insult"),
    (1.0, 3, "smells|smell|stinks|reeks of failure", "insult"),
    (1.0, 9, "laughs|laugh behind back", "insult"),
    (0.6, 2, "@ADJ clown", "insult"),
    (1.0, 4, "too @ADJ @ABILITY", "insult"),
    (0.7, 4, "who @CANNOT @ABILITY", "insult"),
    (1.0, 6, "mother must ashamed", "insult"),
    (1.0, 4, "mother be ashamed of you", "insult"),
    (0.6, 3, "should be fired", "insult"),
    (1.0, 5, "should be fired|spat|kicked spat|on", "insult"),
    (0.7, 2, "nobody asked|needs|likes|wants you", "insult"),
    (1.0, 3, "go|crawl back hole|trailer|cave|gutter", "insult"),
    (1.0, 3, "waste of space|oxygen|air|skin", "insult"),
    (1.0, 3, "never been born", "insult"),
    (1.0, 2, "halt die fresse|klappe|schnauze", "insult"),
    (0.7, 2, "verpiss dich", "insult"),
    (1.0, 2, "fick dich|euch", "insult"),
    (0.7, 3, "gehört gefeuert", "insult"),
    (1.0, 2, "ferme|fermes ta gueule", "insult"),
    (1.0, 2, "va te faire foutre|enculer", "insult"),
    (1.0, 2, "nique ta mère|race", "insult"),
    (1.0, 2, "hijo|hijos de puta", "insult"),
    (1.0, 3, "vete|iros al infierno|carajo", "insult"),
    (1.0, 2, "@INSULT de mierda|merde", "insult"),
    (1.0, 3, "vete a la mierda", "insult"),
    (1.0, 2, "que te jodan", "insult"),
    # threats
    (1.0, 3, "kill|murder|stab|strangle|slaughter|rape|gut you|yourself|himself|herself|themselves", "threat"),
    (1.0, 3, "beat|burn|hang|hunt|choke|hurt|shoot|punch|smash|bury you|yourself", "threat"),
    (1.0, 4, "@WILL @HARM @OWN @BODY", "threat"),
    (1.0, 6, "find you|dich|te and|und|et|y @HARM", "threat"),
    (1.0, 8, "find @HARM @BODY", "threat"),
    (1.0, 2, "stab|strangle|rape|murder|behead him|her|them|you", "threat"),
    (1.0, 4, "know where your children|kids|family|wife|daughter|son|mother go|goes|live|lives|sleep", "threat"),
    (1.0, 3, "break|cut|slit|smash|crush|knock your|yer @BODY", "threat"),
    (0.8, 4, "break|cut|slit|smash your|his|her|every @BODY", "threat"),
    (1.0, 4, "punch|stab|shoot|kick|hit you in|through @BODY", "threat"),
    (1.0, 4, "bullet|knife|bomb in|into|up|through your|his|her @BODY", "threat"),
    (1.0, 3, "burn|torch|bomb your|his|her|their house|home|car", "threat"),
    (1.0, 4, "hit by bus|truck|train|car", "threat"),
    (1.0, 3, "better off without|if you", "threat"),
    (1.0, 3, "schlage|breche|brech dir|ihm die|den @BODY", "threat"),
    (1.0, 3, "te casser|briser|péter la|les|le @BODY", "threat"),
    (1.0, 3, "te|voy|a romper|partir|romperte|partirte la|los|las @BODY", "threat"),
    (1.0, 4, "run you over with", "threat"),
    (1.0, 5, "come your|his|her house|home|door with", "threat"),
    (1.0, 5, "know where you park|live|sleep|work", "threat"),
    (0.7, 3, "watch your back", "threat"),
    (1.0, 5, "leave building|office|room on|in stretcher|bag|coffin|hearse", "threat"),
    (1.0, 5, "deserve|deserves be|to @HARMED", "threat"),
    (1.0, 4, "your|his family|whole deserves|deserve|should burn|die|suffer|hang", "threat"),
    (1.0, 3, "beaten until|till stop|stops moving|breathing", "threat"),
    (1.0, 4, "put down like dog|animal|animals", "threat"),
    (1.0, 3, "jump off roof|bridge|cliff", "threat"),
    (0.8, 4, "do everyone|everybody|us|world favour|favor", "threat"),
    (1.0, 4, "would not be missed", "threat"),
    (1.0, 4, "nobody|noone would|will cry|miss|notice if|you|never", "threat"),
    (1.0, 4, "world would better|cleaner place without you", "threat"),
    (0.7, 3, "just end it|yourself", "threat"),
    (1.0, 8, "hope|wish|ojalá @YOU|@PERSON|this @DEATH", "threat"),
    (0.8, 8, "hope chokes|choke|dies|rots", "threat"),
    (1.0, 3, "drink|swallow bleach and die", "threat"),
    (0.9, 3, "drink|swallow bleach", "threat"),
    (1.0, 2, "get|catch cancer you|and", "threat"),
    (0.7, 2, "die in a fire", "threat"),
    (0.8, 2, "verrecke|krepier endlich|du", "threat"),
    (1.0, 3, "bring|bringe dich um", "threat"),
    (1.0, 3, "keiner|niemand vermisst dich", "threat"),
    (1.0, 3, "dich umbringen|abstechen|erschießen|töten", "threat"),
    (1.0, 5, "te retrouver casser|tuer|buter|frapper", "threat"),
    (1.0, 3, "vais te tuer|buter|crever|égorger", "threat"),
    (1.0, 2, "tue|suicide|pends|crève toi", "threat"),
    (1.0, 3, "personne ne te regrettera|pleurera|manqueras", "threat"),
    (1.0, 5, "te encontrar romperte|matarte|romper|matar", "threat"),
    (1.0, 4, "te voy a matar|romper|partir|encontrar", "threat"),
    (0.8, 2, "mátate|suicídate|muérete", "threat"),
    (1.0, 4, "mátate|suicídate|muérete nadie", "threat"),
    (1.0, 5, "nadie te va extrañar|echar|llorar", "threat"),
    # hate
    (1.0, 10, "@GROUP @HATE", "hate"),
    (1.0, 10, "@HATE @GROUP", "hate"),
    (1.0, 9, "@GROUP @HATEISH @HATEISH", "hate"),
    (1.0, 9, "@HATEISH @GROUP @HATEISH", "hate"),
    (1.0, 1, "@SLUR", "hate"),
    (1.0, 3, "@GROUP are|is not human|people", "hate"),
    (1.0, 2, "@FILTH @GROUP|@ONE", "hate"),
    (1.0, 4, "@GROUP|@ONE belong|belongs in|behind prison|jail|cages|bars|asylums|kitchen|zoo|gutter", "hate"),
    (1.0, 3, "send|ship|throw|kick|deport every|all|the|these|those @GROUP|@ONE back|out|home", "hate"),
    (1.0, 3, "all|those|these|every are|is @CRIMES", "hate"),
    (0.7, 3, "@GROUP are|sont|son|sind @CRIMES", "hate"),
    (1.0, 4, "@GROUP should|must be|all locked|banned|kicked|deported|burned|castrated|removed|die", "hate"),
    (1.0, 4, "@GROUP should|must be|all @HARMED", "hate"),
    (1.0, 3, "gas|lynch|deport|shoot|hang|burn the|all|those @GROUP", "hate"),
    (1.0, 4, "throw|kick|chuck @GROUP out", "hate"),
    (1.0, 3, "no @GROUP allowed", "hate"),
    (0.7, 4, "their|your whole race|kind|people", "hate"),
    (0.7, 4, "your|their kind crawled|came out of", "hate"),
    (1.0, 6, "hole|gutter|cave your|their kind", "hate"),
    (1.0, 5, "@GROUP never built|achieved|invented anything", "hate"),
    (1.0, 5, "never built|achieved|invented anything", "hate"),
    (1.0, 6, "country|city|field|world|school without @GROUP would|is clean|better|free", "hate"),
    (1.0, 6, "without @GROUP would be clean|better|safe", "hate"),
    (0.8, 3, "would be clean again", "hate"),
    (1.0, 5, "before @GROUP were let in", "hate"),
    (0.8, 4, "were let in they|are subhuman|animals", "hate"),
    (1.0, 4, "should be wiped out|gassed|exterminated|deported", "hate"),
    (0.6, 3, "should be kicked|thrown out", "hate"),
    (0.8, 3, "breed like rats|rabbits|cockroaches|flies", "hate"),
    (0.8, 4, "send them back|home", "hate"),
    (0.8, 4, "born criminals|liars|thieves|slaves", "hate"),
    (0.6, 3, "lock them up", "hate"),
    (0.6, 3, "ban them all", "hate"),
    (1.0, 5, "too stupid use computer|ban", "hate"),
    (0.8, 4, "liars and thieves", "hate"),
    (1.0, 5, "belong in kitchen|gutter|zoo|camp|camps|ovens", "hate"),
    (0.8, 5, "kitchen or gutter", "hate"),
    (0.7, 4, "before there are more of them", "hate"),
    (1.0, 5, "should sterilise|sterilize|deport|shoot|hang @GROUP", "hate"),
    (1.0, 5, "@GROUP zu|too|trop|demasiado blöd|dumm|stupid|bêtes|connes|cons|stupides|tontas|tontos", "hate"),
    (1.0, 5, "zu blöd|dumm zum|für", "hate"),
    (0.7, 3, "raus mit ihnen|euch|denen", "hate"),
    (1.0, 5, "@GROUP sind ungeziefer|dreck|abschaum|ratten", "hate"),
    (1.0, 3, "gehören vergast|abgeschoben|erschossen|ausgerottet", "hate"),
    (0.8, 3, "gehören weg|raus", "hate"),
    (1.0, 2, "@PEOPLE are|sind|sont|son @CRIMES", "hate"),
    (1.0, 3, "lock|round up all|every|the|these @GROUP|@ONE", "hate"),
    (1.0, 5, "@GROUP gehören herd|küche|gosse|weg", "hate"),
    (0.8, 4, "trop bêtes pour", "hate"),
    (1.0, 5, "@GROUP sont de|des la|parasites vermine|merde|racaille|parasites|dehors", "hate"),
    (0.8, 4, "qu on les chasse|expulse|brûle", "hate"),
    (1.0, 6, "@GROUP no sirven", "hate"),
    (1.0, 5, "@GROUP son ratas|basura|escoria|animales", "hate"),
    (0.8, 4, "hay que echarlos|echarlas|matarlos|quemarlos", "hate"),
    # sexual
    (1.0, 1, "@EXPLICIT", "sexual"),
    (1.0, 12, "@SEXUAL @SEXUAL", "sexual"),
    (1.0, 8, "@SEXUAL @SEXISH @SEXISH", "sexual"),
    (1.0, 8, "@SEXISH @SEXUAL", "sexual"),
    (1.0, 8, "@SEXUAL @SEXISH", "sexual"),
    (1.0, 4, "@ASK your|me|deine|tes|las|you|my|ma|la @FLESH", "sexual"),
    (0.6, 3, "fucking|fuck live|me|her|him|hard|couples", "sexual"),
    (1.0, 2, "naked|nude|horny|busty|sexy teens|girls|women|babes|milfs|wives|chicks", "sexual"),
    (1.0, 4, "amateur|horny couples|wives|girls|teens|milfs", "sexual"),
    (1.0, 5, "ride|fuck me hard|now|tonight|already", "sexual"),
    (1.0, 3, "sit on my face|lap|cock", "sexual"),
    (1.0, 3, "gave|giving him|her head behind|under", "sexual"),
    (1.0, 4, "spread|spreads her|your legs", "sexual"),
    (1.0, 5, "he|she moaned as rode|fucked|licked|came", "sexual"),
    (1.0, 4, "girls|women|teens stripping|undressing|naked|nude on cam|camera|webcam", "sexual"),
    (0.8, 4, "hardcore sex videos|clips|movies", "sexual"),
    (1.0, 5, "hot girls stripping|waiting|naked", "sexual"),
    (1.0, 4, "thinking about your ass|body|tits|legs|mouth", "sexual"),
    (1.0, 4, "lick you all over", "sexual"),
    (0.8, 3, "let me lick|taste|touch you", "sexual"),
    (1.0, 4, "bend you over", "sexual"),
    (0.8, 4, "make you scream|moan|beg", "sexual"),
    (1.0, 3, "send me nudes|pics|tits|naked", "sexual"),
    (1.0, 5, "pulled off her|his panties|clothes|bra|pants", "sexual"),
    (0.8, 5, "begged him|her|for fuck|take|dick|more", "sexual"),
    (1.0, 6, "night naked mouth thighs", "sexual"),
    (0.8, 5, "mouth between her|his thighs|legs", "sexual"),
    (0.8, 4, "clips|videos|pics free", "sexual"),
    (0.8, 3, "want sex today|tonight|now", "sexual"),
    (1.0, 5, "schick|schicke mir nacktbilder|nacktfotos", "sexual"),
    (0.8, 5, "zog|zieht sich nackt aus", "sexual"),
    (1.0, 5, "wollte von ihm gefickt|genommen", "sexual"),
    (1.0, 6, "déshabilla supplia|embrassa baiser|prendre", "sexual"),
    (1.0, 5, "supplia de la baiser|prendre", "sexual"),
    (1.0, 4, "envoie moi nudes|nues|seins|photos", "sexual"),
    (0.8, 5, "envoie moi des photos nue|nues", "sexual"),
    (1.0, 4, "mándame fotos desnuda|desnudo|tetas", "sexual"),
    (1.0, 6, "quitó la ropa rogó|pidió follara|follar", "sexual"),
    (1.0, 5, "rogó que la follara|follase", "sexual"),
)

#: Words too common to start a rule's evaluation; they still match inside one.
COMMON = frozenset(
 """a an the of to in on off up is are was were be been by as at and or if you your du tu te ta toi ihr he she him her his they them
 their this that who what only would should could can will not no never just end it all every more most so such typical
 only by dear do us there before from with without place free now live live come over want see let me make go back
 count ten read learn write being must use like sick put down leave building office room group field city 
 find know where work hot people man woman person want today
 class clean 
 list label labels comments scores score word words task recall example token tokens removed flag flags statistics counted
 la el los las le les de des du un une que qui por para en y son sont sind ist zu mit von sich aus das der und 
 vais va voy hay nadie personne keiner niemand dein um ich wollte will bite every us ti tus
 bed mouth came means stands train trained speech codebook survey comment flagged filter
 out am anything better already behind person everyone everybody whoever zum für off
 dog cow animal animals monkey rat rats face head eyes nose legs arms neck bus truck than rock old black brown white poor men kids families students ones folk folks
 boss manager intern student show send touch hope wish hard hot night mouth bed ill gonna gotta swear wanna must werde je
 read count code think understand write learn spell program exist live cannot cant unable complete total absolute utter useless
 kind sort leave quit resign body ass each the la lost mouth get house home car bus train truck better kick throw ship foreigner pole teens every all""".split()
)

#: Words that are never read as a misspelling of another.
ORDINARY = frozenset(
    """res tier tiers con sans vor changed change report root roots charged closed lower later partie parties sector sections
    rank ranks row rows rate rates ratio title titles class classes assess analysis cumulative cocktail dickey
    trade trader traders clock block blocks rock sock cook book look shift shirt short sheet bench batch beach patch
    duck deck dock disk count counts country county test tests text texts set sets sum some seems same stub stable
    price prices priced worker workers vector plot plots pilot load loads loader land lands band bands bond bonds bind best cases case""".split()
)
