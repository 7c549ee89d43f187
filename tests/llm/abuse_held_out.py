"""Sentences that measure how the abuse operator does on wordings other than those of the test tables.

(category or none, text).  The first set was written right before the word lists, by
the same author, and some of its words (oxygen, kitchen, snivelling, ...) are in the
lists, so its figure flatters the method.  The second set was written after the
method was done, and nothing was changed on account of it.
"""

HELD_OUT = [
    ("abusive", "You absolute Bastrad, give me my keys back."),
    ("abusive", "Du Vollidoit hast die Akte verloren."),
    ("abusive", "Sie nannte die Klägerin vor allen Leuten eine Schlmape."),
    ("abusive", "Quel conard, ce greffier."),
    ("abusive", "You stupid cow, nobody asked for your opinion."),
    ("abusive", "Callate, hijo de puta."),
    ("abusive", "He told the clerk to shove the receipt up her arse."),
    ("abusive", "Your brother is nothing but a snivelling little weasel."),
    ("abusive", "I swear I'll smash your teeth in if you show up on Monday."),
    ("abusive", "We are going to cut you into pieces, Harrow."),
    ("abusive", "If she testifies, I am going to strangle her with my own hands."),
    ("abusive", "They should have drowned you at birth."),
    ("abusive", "Why don't you just hang yourself and spare us the trial?"),
    ("abusive", "The defendant is an utterly brainless oaf, and everyone knows it, the e-mail said."),
    ("abusive", "Shut your filthy mouth, you old hag."),
    ("abusive", "You are a disgrace and a waste of oxygen."),
    ("abusive", "That judge is a complete moron."),
    ("abusive", "fuuuck youuu, you lying snake"),
    ("abusive", "you f u c k i n g loser"),
    ("abusive", "What a pathetic excuse for a human being you are."),
    ("abusive", "Halt endlich dein dreckiges Maul, du alte Hexe."),
    ("abusive", "Dieser Richter ist ein kompletter Vollpfosten."),
    ("abusive", "Ich werde dich umbringen, wenn du noch einmal anrufst."),
    ("abusive", "Dir schneide ich die Kehle durch."),
    ("abusive", "Sie sind doch ein erbärmlicher Wurm, Herr Direktor."),
    ("abusive", "Verpiss dich endlich, du Missgeburt."),
    ("abusive", "Na, du fette Sau, bist du schon wieder da?"),
    ("abusive", "Geh doch sterben, du nutzloses Stück Dreck."),
    ("abusive", "Va te faire foutre, espèce de raclure."),
    ("abusive", "Vous n'êtes qu'une ordure et un menteur."),
    ("abusive", "Je vais te crever les yeux, salope."),
    ("abusive", "Ton fils est un vrai débile."),
    ("abusive", "Ferme ta grande gueule, vieille vache."),
    ("abusive", "Pendez-vous donc, personne ne vous regrettera."),
    ("abusive", "Eres un imbécil y un cobarde."),
    ("abusive", "Sei uno stronzo, avvocato."),
    ("abusive", "Jij vuile klootzak, betaal mij terug."),
    ("abusive", "Ty kurwa jebana, zapłacisz za to."),
    ("abusive", "You w@nk3r, you will pay for this."),
    ("abusive", "Look at that fat ugly pig in the witness box, he whispered."),
    ("hateful", "The Kikes run this court and ought to be wiped off the map."),
    ("hateful", "Muslims are animals and should be deported on the next ship."),
    ("hateful", "Gas the lot of them, every last refugee."),
    ("hateful", "The leaflet said that gypsies are thieving scum and must be driven out."),
    ("hateful", "Women are too stupid to sit on a bench, send them back to the kitchen."),
    ("hateful", "Somebody ought to shoot those Barrowmen, they are a plague on this valley."),
    ("hateful", "Disabled people are a burden and should never have been born."),
    ("hateful", "The only good Ostrian is a dead Ostrian."),
    ("hateful", "Burn down every mosque with the rats still inside."),
    ("hateful", "All Jews are liars and bloodsuckers."),
    ("hateful", "Ausländer raus, ihr seid alle Abschaum!"),
    ("hateful", "Schwule gehören an die Wand gestellt."),
    ("hateful", "Diese Flüchtlinge sind nichts als Ungeziefer."),
    ("hateful", "Die Zigeuner stehlen alle, man sollte sie vertreiben."),
    ("hateful", "Man müsste alle Behinderten vergasen."),
    ("hateful", "Les juifs sont une race de voleurs, il faut les éliminer."),
    ("hateful", "Les Arabes dehors, qu'ils crèvent tous."),
    ("hateful", "Ces migrants ne sont que des cafards."),
    ("hateful", "Un bon pédé est un pédé mort."),
    ("hateful", "Filthy n1ggers, go back to the jungle."),
    ("hateful", "Immigrants spread disease and breed like vermin."),
    ("hateful", "No faggots in this club, read the sign on the door."),
    ("sexual", "He boasted that she fingered herself while he watched."),
    ("sexual", "She sucked him off in the car park."),
    ("sexual", "He wanted to shove his dick down her throat."),
    ("sexual", "The text read: I'm so horny, I want to fuck you hard tonight."),
    ("sexual", "He rubbed her clit until she came."),
    ("sexual", "send me a picture of your tits"),
    ("sexual", "She spread her legs and begged him to ride her."),
    ("sexual", "his throbbing penis slid between her breasts"),
    ("sexual", "Billige Nutte, zeig mir deine Titten."),
    ("sexual", "Er steckte ihr die Zunge zwischen die Beine und leckte sie."),
    ("sexual", "Er wollte ihr in den Mund spritzen."),
    ("sexual", "Ich will deine nasse Muschi lecken."),
    ("sexual", "Il bandait et voulait lui lécher la chatte."),
    ("sexual", "Elle lui a taillé une pipe dans les toilettes."),
    ("sexual", "Montre-moi ton gros cul, je vais te prendre par derrière."),
    ("sexual", "He jerked off over her underwear."),
    ("sexual", "Quiero follarte toda la noche."),
    ("sexual", "she moaned as he pounded her from behind"),
    ("none", "The Idiot by Dostoevsky was among the books listed in the inventory."),
    ("none", "The coating retards the spread of flame and was tested twice."),
    ("none", "The menu offered faggots and peas at two crowns a plate."),
    ("none", "The blue tits nested under the eaves in April."),
    ("none", "A stray dog bit the postman on the thigh."),
    ("none", "The doctor examined her breasts and found no lump."),
    ("none", "He was treated for cancer of the penis at the county hospital."),
    ("none", "The pig farmer sold forty swine and a cow at the market."),
    ("none", "The witness said that he had been insulted in coarse language."),
    ("none", "The court finds the argument wholly without merit."),
    ("none", "The minister's policy is short-sighted and will fail."),
    ("none", "Refugees are entitled to be heard before a decision is made."),
    ("none", "The charge of murder was reduced to manslaughter."),
    ("none", "I will kill the lights before I lock the workshop."),
    ("none", "You will pay the sum of 400 crowns by Friday."),
    ("none", "The plague of 1665 reached the village by way of the port."),
    ("none", "The rats in the granary must be exterminated before the harvest."),
    ("none", "The dog had to be put down by the veterinary surgeon."),
    ("none", "Moby Dick was lent by the library on 4 May."),
    ("none", "Mr Dick Cockburn appeared for the respondent."),
    ("none", "The tenant kept a cock and six hens in the yard."),
    ("none", "The ball cock of the cistern was defective."),
    ("none", "Under the Idiots Act 1886 the guardian had to give notice."),
    ("none", "The victim was raped and the appellant was convicted."),
    ("none", "The complainant alleged a sexual assault on the train."),
    ("none", "He shot the deer and hung it in the barn."),
    ("none", "Your appeal has no prospect of success and you would be wise to withdraw it."),
    ("none", "I hope you will accept this offer."),
    ("none", "Immigrants pay the same fees as all others."),
    ("none", "The rabbits breed quickly in the spring."),
    ("none", "He licked the stamp and posted the letter."),
    ("none", "The nurse washed the patient's genitals before surgery."),
    ("none", "She came into the room and sat on the bench."),
    ("none", "No dogs are allowed in our street during the fair."),
    ("none", "The term bastard is used in the statute to mean a child born out of wedlock."),
    ("none", "The engine block was cracked and the screw had been cut."),
    ("none", "The painting shows a naked woman with a child."),
    ("none", "You are free to leave at any time."),
    ("none", "The fat was rendered and the dirt removed with a brush."),
    ("none", "He was called names that need not be repeated."),
    ("none", "Das Schwein wurde am Montag geschlachtet."),
    ("none", "Der Hund ist ein Schäferhund und gehört dem Kläger."),
    ("none", "Er ist ein guter Zeuge und hat die Wahrheit gesagt."),
    ("none", "Die Ratten im Keller müssen vernichtet werden."),
    ("none", "Ich weiß, wo der Schlüssel liegt."),
    ("none", "Die Brust der Patientin wurde untersucht."),
    ("none", "Flüchtlinge haben Anspruch auf eine Anhörung."),
    ("none", "Der Zeuge hat den Hahn zugedreht und das Ventil ersetzt."),
    ("none", "Ich werde den Vertrag brechen, schrieb der Pächter."),
    ("none", "Das Landgericht hat den Antrag als dumm und unbegründet bezeichnet."),
    ("none", "Le chien du voisin a mordu la plaignante à la cuisse."),
    ("none", "La chatte a eu quatre petits dans la grange."),
    ("none", "Les ordures ménagères sont ramassées le lundi."),
    ("none", "Une baguette et un bâtard ont été volés à la boulangerie."),
    ("none", "Je vais te montrer le registre demain."),
    ("none", "Les étrangers doivent déclarer leur domicile à la mairie."),
    ("none", "Il a reçu un baiser de sa mère à la gare."),
    ("none", "Le médecin a examiné les seins de la patiente."),
    ("none", "Les rats ont détruit la récolte et il faut les éliminer."),
    ("none", "The boxer said he would beat his opponent in the third round."),
    ("none", "The bank will pursue you for the debt."),
    ("none", "The animals belong in the stable at night."),
    ("none", "The party argued that the rule was an ass."),
    ("none", "Whore Street was renamed in 1890 at the request of the parish."),
    ("none", "The hearing was a waste of time, he complained."),
    ("none", "It would be a burden on the parish to maintain the road."),
    ("none", "The parasite was found in the intestine of the horse."),
]

HELD_OUT_2 = [
    ("abusive", "Oh do be quiet, you gormless twit."),
    ("abusive", "My landlord is a thieving bastard, she told the clerk."),
    ("abusive", "You're nothing but a lying sack of garbage."),
    ("abusive", "Next time I see you I will kick your ribs in."),
    ("abusive", "I hope your whole family rots in the ground."),
    ("abusive", "Crawl back into your hole, you spineless slug."),
    ("abusive", "The letter ended with the words: drop dead, hag."),
    ("abusive", "He called his own solicitor a brainless donkey."),
    ("abusive", "Du bist so eine dumme Gans."),
    ("abusive", "Euch Schweinehunde sollte man alle einsperren."),
    ("abusive", "Ich schlage dir den Schädel ein."),
    ("abusive", "Hau ab, du Wichsser."),
    ("abusive", "Espèce de gros porc, rends-moi mon argent."),
    ("abusive", "Tu n'es qu'un pauvre con."),
    ("abusive", "On va te casser les jambes, traître."),
    ("abusive", "You a$$hole, I know where your kids go to school."),
    ("abusive", "What a miserable little worm he is."),
    ("hateful", "Those Pellorians are nothing but vermin."),
    ("hateful", "All foreigners are thieves and should be driven out of the country."),
    ("hateful", "Gypsies belong in a cage."),
    ("hateful", "They breed like cockroaches in that quarter."),
    ("hateful", "Hang the gays, hang them all."),
    ("hateful", "Die Juden sind eine Plage und müssen vernichtet werden."),
    ("hateful", "Ces étrangers sont de la racaille."),
    ("hateful", "Les handicapés sont des déchets."),
    ("sexual", "He wrote that he wanted to lick her nipples."),
    ("sexual", "I want your cock in my mouth, the message read."),
    ("sexual", "They fucked on the kitchen table."),
    ("sexual", "Er will sie von hinten ficken."),
    ("sexual", "Il rêvait de caresser ses fesses nues et de la baiser."),
    ("none", "The solicitor called his next witness, a dairy farmer."),
    ("none", "The horse kicked the groom in the ribs."),
    ("none", "The refugees were housed in the old school."),
    ("none", "The gays and lesbians of the town formed an association."),
    ("none", "The cockroaches in the kitchen were treated with powder."),
    ("none", "The fool in the play speaks the last line."),
    ("none", "He was hanged in 1764 for the murder of a miller."),
    ("none", "You are wrong about the date of the contract."),
    ("none", "Kill the process and restart the server."),
    ("none", "Die Gänse und der Hund liefen auf die Straße."),
    ("none", "Der Beklagte hat die Klägerin nicht beleidigt."),
    ("none", "Le porc et le bœuf ont été vendus au marché."),
    ("none", "Les femmes sont entrées dans la salle d'audience."),
    ("none", "The massage of the thigh was part of the treatment by the nurse."),
    ("none", "We hope that you will suffer no loss."),
    ("none", "She described the decision as stupid and unfair."),
    ("none", "The rapist was sentenced to nine years."),
    ("none", "The lice were removed from the child's hair."),
    ("none", "The screw was tightened and the nut replaced."),
    ("none", "They should be removed from the list of creditors."),
]
