"""The small labelled table from which the tagger of personal information is trained.

Each row is a sentence, subject, signature or file name of the mail domain; mentions are marked as
[kind|text] and slots such as {P} are filled with invented persons, numbers and addresses, so that the
tagger learns shapes and surroundings rather than particular people. Everything outside marks is
labelled as no mention.
"""

from __future__ import annotations

import random
import re

from postmill.llm.names import GIVEN

# Labelled rows. {P} person, {L} surname alone, {G} given name alone, {E} e-mail address,
# {T} telephone, {C} tax code, {D} identity document, {A} street address; {O} organisation, {W} town,
# {N} number, {X} date, {M} amount, {V} VAT number, {F} file stem, {J} reference, {H} web host, {I} message id.
ROWS = """
Ho sentito {P} ieri pomeriggio: mi ha lasciato il recapito {T}.
Ho sentito il dott. {P} stamattina e mi ha lasciato il numero {T}
Ho sentito la dott.ssa {P} ieri: il recapito è {T}.
Ho sentito sig.ra {L} ieri pomeriggio: mi ha lasciato il recapito {T}. La rata scade il {X}.
Il referente è {P}, raggiungibile a {E} oppure al numero {T}.
Il referente è la dott.ssa {P}, raggiungibile a {E} oppure al numero {T}.
Il referente è il signor {P}, che risponde a {E}.
Per ogni chiarimento può chiamare {P} al {T}.
Per ogni chiarimento può chiamare l'avv. {L} al {T}. È opportuno che il consorzio lo sappia.
Per informazioni telefonare a {P} ({T}) nelle ore di ufficio.
Le credenziali sono state inviate a {E} su richiesta di {P}.
Le credenziali sono state inviate a {E} su richiesta dell'ing. {P}. Il portale resta chiuso.
Si prega di rispondere a {E} e per conoscenza a {E}.
La notifica a {P} presso {A} non è andata a buon fine.
La notifica all'ing. {P} presso {A} non è andata a buon fine. La strada è interrotta.
La notifica alla dott.ssa {P} presso {A} è tornata al mittente.
La notifica al signor {P} presso {A}
L'originale va spedito a {W}, {A}, all'attenzione di {P}.
L'originale va spedito a {W}, {A}, all'attenzione del signor {P}. Gli allegati sono {N}.
Il sopralluogo si farà in {A} alla presenza di {P} e {P}.
Il sopralluogo si farà in {A} alla presenza di {P} e il signor {P}.
Il sopralluogo si farà in {A} alla presenza di sig.ra {L} e dott. {P}.
L'intestatario {P}, codice fiscale {C}, è residente in {A}.
L'intestataria {P}, codice fiscale {C}, abita in {A}. Ai sensi del regolamento interno si procede.
Delega rilasciata a {P} (c.f. {C}), tel. {T}.
Delega rilasciata al signor {P} (c.f. {C}), tel. {T}. Qualora la somma di {M} non sia saldata, si procederà.
Delega rilasciata a sig.ra {L} (c.f. {C}), tel. {T}. Purtroppo il file non si apre.
C.F. dell'erede: {C}; carta d'identità {D}.
C.F. dell'erede: {C}; passaporto {D}. Gli eredi hanno chiesto una copia.
Il documento esibito da {P} è {D}.
Il documento esibito da avv. {L} è {D}. Le cifre della tabella {N} non tornano: mancano {M} rispetto al {X}.
Il passaporto di {P} ha il numero {D}.
Fax e telefono dell'ufficio restano invariati: {T}.
Egregio dott. {L},
Egregio sig.ra {L},
Gentile {L},
Gentile avvocato {L},
Gentile sig.ra {L},
Gent.ma avvocato {L},
Egregio {L},
Gent.mo ingegner {L}, la ringrazio.
Alla cortese attenzione di dott. {L}
Alla cortese attenzione di avvocato {L}
Gentile dott. {L}, la pratica è ancora aperta.
Dear Mr {L},
Sehr geehrter Herr {L},
Sehr geehrte Frau {P},
Chère Madame {L},
Spett.le Ufficio,
Spett.le {O}, si trasmette la fattura.
Buonasera, Ciao, Salve, Buongiorno,
Cordiali saluti / {P} / {O} / {A} - {N} {W} / Tel. {T} / PEC: {E} / P.IVA {V}
Distinti saluti. / Avv. {P} / Ufficio contratti / {O} / Cell. {T} / {E} / www.{H} / P.IVA {V}
Saluti, / -- / Geom. {P} / Responsabile amministrativo / {A} - {N} {W} / tel/fax {T} / mail {E}
Grazie e buon lavoro / Dott. {P} / Legale rappresentante / ☎ {T} / e-mail: {E}
A presto / {G}
Cordialità / {G} / / Inviato dal mio telefono
Saluti, / {P} / Consulente del lavoro / T. {T} / {E}
Viele Grüße / {P} / Area tecnica / {A} - {N} {W} / www.{H}
Kind regards, / {P} / Praticante / {O} / P.IVA {V}
Cordialement, / {G} / / Diese Nachricht ist vertraulich und nur für den Empfänger bestimmt.
Segretaria di direzione | {O} | {A} - {N} {W} | Tel. {T} | P.IVA {V}
{P} / Ufficio acquisti | {O} | www.{H} | P.IVA {V}
Da: {P} <{E}> / Inviato: {X} / A: {E} / Oggetto: Pratica n. {J}
*Da:* {P} <{E}> / *Inviato:* {X} / *A:* {E} / *Oggetto:* Integrazione pratica {J}
Von: {P} <{E}> / Gesendet: {X} / An: {E} / Betreff: R: Rif. {J}
From: {P} <{E}> / Sent: {X} / To: {E} / Subject: Fattura {J} - importo {M}
De: {P} <{E}> / Envoyé: {X} / À: {E} / Objet: Sollecito
Il giorno {X} alle ore 10:22 {P} <{E}> ha scritto:
Il {X}, 06:42, {P} / <{E}> ha scritto:
Il {X} {P} ha scritto:
In data {X} 11:05, {P} scriveva:
On {X} at 19:46, {P} <{E}> wrote:
Am {X} um 12:58 schrieb {P} <{E}>:
Le {X} à 09:33, {P} a écrit :
Citando {P} ({E}):
-----Messaggio originale----- / Da: {P} <{E}>
---------- Messaggio inoltrato ---------- / Da: {P} <{E}> / Inviato: {X} / Oggetto: I: Convocazione per il {X}
Delega di {P} ({C})
R: Delega dell'arch. {P} ({C})
Fwd: Delega di sig.ra {L} ({C})
I: Documento {D} di {P}
AW: Documento {D} della signora {P}
R: Documento {D} di dott. {L}
{P} c.f. {C}
R: {P} c.f. {C}
I: {P} c.f. {C}
R: R: {P} c.f. {C}
AW: {P} c.f. {C}
Fwd: {P} c.f. {C}
Le spese restano a carico del comune salvo diversa volontà. A oggi non risulta pervenuta alcuna risposta, né la perizia né la relativa ricevuta.
ricorso.zip
visura.xlsx planimetria.jpg quietanza.docx
ricorso.docx / A oggi non risulta pervenuta alcuna risposta.
Saluti, / Avv. {P} / T. {T} / PEC: {E}
Cordialità / {P} / Tel. {T}
Su richiesta di prof.ssa {L}. Il tecnico passerà lunedì.
Le credenziali sono state inviate a {E} su richiesta di prof.ssa {L}. Gli eredi hanno chiesto una copia.
Alla presenza di dott.ssa {L} e {P}. Sarà cura del locatore.
Saluti, / / -- / {G} / / Avviso legale / Rispetta i boschi: non stampare questa mail.
Cordialità / -- / {G} / / Diese Nachricht ist vertraulich.
Distinti saluti. / -- / {P} / Segretaria di direzione / {O} / {A} - {N} {W} / {T}
Grazie e buon lavoro / / -- / {G} / / Il {X} {P} ha scritto:
A presto / - - - - - - - - / {G} / / {P} / {O}
Cordiali saluti / ============================== / {P} / {O} / P.IVA {V} / / ***
Viele Grüße / / ________________________ / {G} / / ---------- Messaggio inoltrato ----------
In attesa di riscontro, porgo cordiali saluti. / {G} / / {P} / www.{H}
In attesa di riscontro, porgo cordiali saluti. / / {G} / / Le informazioni contenute in questo messaggio sono riservate.
Saluti, / {G} / / Citando {P} ({E}):
Cordialità / / {G} / / Citando {P} ({E}):
Grazie e buon lavoro / {G} / / In data {X} 10:12, {P} scriveva:
A presto / / {G} / / Egregio avvocato {L},
A presto / -- / {P} / {E} / P.IVA {V} / / Avviso legale
Distinti saluti. / / -- / Avv. {P} / {O} / {E} / www.{H}
Distinti saluti. / - - - - - - - - / {P} / {O} / mail {E} / / Inviato dal mio telefono
Cordiali saluti / -- / Dott. {P} / Praticante / {O} / {A} - {N} {W} / {E} / P.IVA {V}
Saluti, / ________________________ / {P} / {A} - {N} {W} / T. {T} / www.{H}
Kind regards, / -- / {G} / / Sent from my phone
Best, / {P} / {A} - {N} {W} / {T} / {E}
Thanks / / {P} / / *** / This message is intended only for the addressee.
Cordialità / / {P} / Loc. senza numero / {E}
Grazie e buon lavoro / ******************** / {P} / Consulente del lavoro / {E} / www.{H} / P.IVA {V}
Bien à vous / -- / {G} / / Von unterwegs gesendet
{O} / {E} / P.IVA {V}
{A} - {N} {W} / {E}
Ufficio contratti | {T} | {E} | www.{H} | P.IVA {V}
Area tecnica | Tel. {T} | {E} | www.{H}
{O} | {A} - {N} {W} | {E} | P.IVA {V}
Consulente del lavoro / T. {T} / mail {E} / / Il {X}, 09:42, {P} / <{E}> ha scritto:
Praticante / {T} / mail {E} / / Avviso legale
Cordiali saluti / {G} / / In data {X} 11:12, {P} scriveva:
Cordiali saluti / / {G} / / Il giorno {X} alle ore 10:22 {P} <{E}> ha scritto:
Mi dispiace per il rita¬ / rdo: il listino è già trasmesso. I colli sono cinque.
{A} - {N} {W} / tel/fax {T} / {E} / www.{H}
{W} / {E} / www.{H}
P.IVA {V} / / {P}
{O} - Settore Personale
Settore Personale - {O}
Fwd: Il dott. {P} c.f. {C}
RE: {P} c.f. {C}
R: R: Credenziali per {E}
Credenziali per {E}
Richiamare {T}
I: Richiamare {T}
Fwd: Richiamare {T}
RE: Nomina {P}: la comunicazione
Nomina il signor {P}: la visura
Pratica {P} - l'occupazione del marciapiede
AW: Pratica {P} - il taglio del bosco
Sopralluogo in {A}
R: Sopralluogo in {A}
Convocazione per il {X}
Scadenza {X}: la fornitura di materiali
R: Rif. {J} / CIG {K}
Fattura {J} - importo {M}
Pratica n. {J}
RE: Integrazione pratica {N}
POSTA CERTIFICATA: Richiesta di autenticare la convocazione
ANOMALIA MESSAGGIO: Trasmissione del verbale
Sollecito: l'iscrizione all'albo dei fornitori
elenco {C}.xlsx / Il codice gara è {K} e la partita IVA della ditta è {V}.
verbale {C}.pdf / La pompa del pozzo si è fermata.
quietanza {C}.exe perizia {C}.docx modulo {C}.tar.gz
Ho sentito {P} ieri pomeriggio: mi ha lasciato il recapito {T10}.
Ho sentito l'arch. {P} ieri: mi ha lasciato il / recapito {T10}. Vorremmo sapere quale sia lo stato.
Fax e telefono dell'ufficio restano / invariati: {T10}. Il canone è dovuto.
Per ogni chiarimento può chiamare {P} al {T10}. La rata scade.
Ho sentito la signora {P} ieri pomeriggio: mi ha lasciato il recapito {T}.
Ho sentito la / signora {P} ieri pomeriggio: mi ha lasciato il recapito {T}.
Per ogni chiarimento può chiamare la signora {P} al {T}. La rata scade.
Il referente è la signora {P}, raggiungibile a {E} oppure al numero {T}.
L'intestatario la signora {P}, codice fiscale {C}, è residente in {A}.
RE: Nomina la signora {P}: il piano di rientro
AW: Pratica la signora {P} - il deposito cauzionale
Il referente è geom. {L}, raggiungibile a {E} oppure al numero {T}.
Ho sentito geom. {L} ieri pomeriggio: mi ha lasciato il recapito {T}. Ai sensi del regolamento.
L'originale va spedito a {W}, {A}, all'attenzione di geom. / {L}.
Le credenziali sono state inviate a {E} su richiesta di sig. / {L}. Il tecnico passerà.
Le credenziali sono state inviate a {E} su richiesta di avv. / {L}. Dal {X} si procede.
Il sopralluogo si farà in {A} alla presenza di avv. / {L} e {P}.
Il sopralluogo si farà in {A} alla presenza di {PI} e {P}. Il bonifico è tornato.
Ho sentito {PI} ieri pomeriggio: mi ha lasciato il recapito {T}.
Ho sentito / {PI} ieri pomeriggio: mi ha lasciato il recapito {T}.
La notifica a {PI} presso {A} non è andata a buon fine.
La notifica a / {PI} presso / {A} non è andata a buon fine.
L'originale va spedito a {W}, {A}, all'attenzione di {PI}. Per la manutenzione occorre pagare.
Le credenziali sono state inviate a {E} su richiesta di {PI}. Ai sensi del regolamento.
Le credenziali sono state inviate a {E} su richiesta di / {PI}. Nessuno ha mai visto la perizia.
Il documento esibito da {PI} è {D}. Si sollecita il riscontro.
Delega di {PI} ({C})
Delega rilasciata a {PI} (c.f. {C}), tel. {T}.
Il referente è {PI}, raggiungibile a {E} oppure al numero {T}.
L'intestatario / {PI}, codice fiscale {C}, è residente in {A}.
Saluti, / -- / {PI} / {O}
Cordialità / {PI} / / Avviso legale
L'intestatario {P}, codice fiscale {C}, è residente in {A}. / Durante la visita a {W} sono stati contati {N} vani.
L'intestatario {P}, codice fiscale {C}, è residente in {A}. / / L'offerta di {M} è la più bassa.
L'intestatario sig.ra {L}, codice fiscale {C}, è residente in / {A}. / Cordiali saluti
L'intestatario l'ing. {P}, codice fiscale {C}, è residente in {A}. / A oggi non risulta pervenuta risposta.
Oggetto: Sopralluogo in {A} / / Buonasera, / Il tecnico passerà.
Geom. {P} / {A} - {N} {W} / www.{H}
{P} / {A} - {N} {W} / tel/fax {T}
{O} / {A} - {N} {W} / ☎ {T} / e-mail: {E}
{O} / {A} - {N} {W} / Cell. {T} / P.IVA {V}
Saluti, / {P} / {A} - {N} {W} / Tel. {T}
Gli allegati sono {N}. Vale / il parere fisico-chimico espresso a {W}.
Il documento esibito da {P} è {D}. Vale il parere tecnico-amministrativo espresso a {W}.
Quantità {N} colli. Vale il parere agro-alimentare espresso a {W}. Il profilo resta immutato.
{W} / REGISTRO ATTI / ALLEGATO V / Chi intende partecipare deve firmare.
contratto.txt / Il collegio ha deciso.
verbale.pdf.p7m
Le {X} à 09:33, {P} a écrit : / Bonjour, / Le bureau vérifiera où le reçu a été déposé.
Bonjour, / / Les pièces jointes ne sont pas lisibles.
Bonjour, Guten Tag, Hello, Madame, Monsieur, Dear all, Sehr geehrte Damen und Herren,
Trasmissione della polizza
R: Trasmissione dello stato di avanzamento
Trasmissione del verbale
Integrazione pratica {N}
La fornitura di materiali - riscontro
L'accesso agli atti - riscontro
Richiesta di esaminare con calma il contratto
L'originale va spedito a {W}, {A}, all'attenzione di {P}. La rata numero {N} è la prima.
L'originale va spedito a {W}, / {A}, / all'attenzione di avv. {L}. Il canone è dovuto.
Legale rappresentante / {A} - {N} {W} / Tel. {T}
visura_{FN}.pdf contratto.pdf elenco_297572.docx
verbale_{FN}.zip / Nel frattempo il locatore ha cambiato indirizzo.
CI {FN}.pdf quietanza 19-1-2025.PDF.P7M
ricorso_{FN}.tar.gz fattura {C}.tif planimetria_619614.pdf
quietanza_{FN}.tif / La riunione è convocata per {X}.
CI {FN}.jpg modulo.xml CI {FN}.docx
modulo_{FN}.docx contratto_{FN}.xlsx / Nel frattempo il locatore ha cambiato indirizzo.
fattura_{P1}.7z perizia_{FN}.xml visura 2-3-2025.PDF
planimetria_{FN}.txt elenco_{P1}.jpg
CI {P1}.tif verbale_{FN}.pdf.p7m
perizia_{P1}.docx modulo_383596.pdf
elenco_{FN}.zip planimetria.xml
ricorso {C}.pdf fattura 3-3-2025.PDF
planimetria {C}.tif visura.txt
quietanza.pdf modulo_619614.pdf contratto_711289.exe / La riunione è convocata per {X}.
CI {P1}.xml quietanza.pdf / Più volte l'assicurazione ha promesso di sottoscrivere la diffida.
Il codice gara è {K} e la partita IVA della ditta è {V}.
La partita IVA della ditta è {V}. Il ponteggio va smontato entro trenta giorni.
Il riferimento interno è il n. {N10}, da citare in ogni risposta.
In riferimento alla pratica n. {J}, l'ufficio ragioneria chiede di rettificare la delibera.
L'identificativo del messaggio precedente è <{I}>.
Materiale del lotto {B} consegnato il {X}, quantità {N} colli.
La quota a carico del condominio di {W} ammonta a {M}, IVA compresa.
Le chiavi del magazzino di {W} si ritirano previo appuntamento.
Durante la visita a {W} sono stati contati {N} vani e due cantine umide.
Tra le spese di {W} figurano {M} per il collaudo dei lavori.
Il pagamento di {M} è stato registrato il {X} con causale «la nomina del revisore».
Dal {X} l'accesso all'archivio di {W} avverrà solo con firma digitale.
Secondo l'impresa esecutrice, la proprietà dell'area di {W} è tuttora contestata.
{O} - Amministrazione
Ufficio Gare - {O}
{O} ha trasmesso la polizza alla Prefettura.
La fattura di {O} è stata pagata da {O}.
Deliberazione n. 298 del {X} / Art. 4 / Fascicolo {J} / ALLEGATO III
Qualora la somma di {M} non sia saldata, si procederà a mezzo posta certificata. Nessuno ha mai visto la perizia.
Gli allegati sono {N}: manca però la lettera d'incarico. Sarà cura della ragioneria dare notizia dell'esito.
Perché la domanda sia accolta occorre pagare {M} di diritti. Ricordo che il listino vale {N} mesi.
Abbiamo ricevuto il contratto soltanto lunedì scorso. Chiediamo cortesemente se sia possibile anticipare a {W}.
Dall'esame di quanto inviato è emerso che il canone è dovuto. Vorremmo sapere quale sia lo stato. Serve una risposta chiara.
Mi dispiace per il ritardo: il modulo era finito nella posta indesiderata. Resta inteso che la visura è allegata. Vale il parere fisico-chimico.
Il tecnico passerà venerdì tra le 14 e le 12. Per la chiusura dell'attività servono due preventivi. Non è più necessario archiviare la relazione. Allego una fotografia.
The tenant at {W} asked for a résumé of costs, roughly {M}. Our records don't show any reply. Please find attached the offer.
Die Frist für die Prüfung läuft am {X} ab. Der Mieter hat die Schlüssel übergeben. Wir bestätigen den Eingang Ihrer Mitteilung vom {X}.
Veuillez régler la somme de {M} dans un délai de {N} jours. La réunion prévue à {W} a été déplacée au {X}.
AVVISO DI RISERVATEZZA: il presente messaggio e i suoi allegati possono contenere dati protetti. Avviso legale. Rispetta i boschi: non stampare questa mail.
This message is intended only for the addressee. If you received it in error please delete it and tell the sender. Von unterwegs gesendet. Sent from my phone
L'assemblea ha approvato la proroga della concessione con {N} voti. Con delibera del {X} è stato scelto il metodo più prudente. Se la prefettura non si oppone, il capitolato diventa esecutivo.
Ai sensi della normativa sulla protezione dei dati, si informa che la presente è indirizzata al solo interessato. Prima di stampare, pensa all'ambiente.
Il Comune di {L} e il Tribunale di {L} hanno risposto. La Farmacia {L} resta aperta. Il Consorzio di Bonifica {L} scrive.
Il Presidente della Camera Arbitrale di {L} e l'Istituto Comprensivo {L} ringraziano. Unione dei Comuni {L}.
""".strip().split("\n")

#: Names of organisations in the rows hold surnames that are no mentions.
_SURNAME_AS_PART = re.compile(r"(Comune di|Tribunale di|Farmacia|Consorzio di Bonifica|Camera Arbitrale di|Istituto Comprensivo|Unione dei Comuni) \{L\}")

_HEADS = "Ros Bian Fer Mar Col Bar Gal Con Cos Gio Man Riz Lom Mor Bel Tes Vil Cat Pal Gre San Val Cap Rug Ser Vit Fab Gat Mon Pel Sor Tor Dol Ebr Ols Urb Ilv Ans Lanz Qua Cor Nerv Stev Zor Per Bra Run Sga Dru Cre Fan Fro Ghi Laz Maz Ol Ris Rab Ben Tol".split()
_MIDS = "a e i o u an el ir on ar il or en un al er ol at et av ud ov iv ed".split()
_TAILS = "netti roni acci nasco reddu rigo licco naldo rone niani rozzi lucci relli nuolo rero vaghi nisi resi rotto latti noli vini sini lli zzi sti nti rdi telli dotto vetti rani bini gno naro raro laro raghi laghi leddu neddu veddu letti detti vacci lacci ricco tasco basco lonno tini mini doni zozzi succi lupo ardo ese ich ner".split()
_ROADS = "Via;Viale;V.le;Piazza;P.zza;Corso;C.so;Vicolo;Largo;Loc.;Strada;VIA;via;Contrada;Piazzale;Lungomare".split(";")
_PLACES = "della Fornace;delle Rondini;dei Mandorli;del Castagno;della Pergola;dei Pescatori;del Mulino Vecchio;Garibaldi;Roma;della Sorgente;delle Querce;dei Tigli;del Lavatoio;San Giorgio;XX Settembre;dell'Olmo;Dante Alighieri;dei Vasai;del Pozzo;della Repubblica;delle Ginestre;degli Orti".split(";")
_GERMAN = "Mühlweg Brunnengasse Bahnhofplatz Lindenstraße Kirchgasse Hauptstraße Gartenweg Schulplatz Rosenallee Bergstrasse Ringstraße Marktgasse".split()
_TOWNS = "Colle Brughiera;Borgo Ventoso;San Corvino;Lago Cenere;Monte Lucciola;Villa Ginestra;Fonte Rugiada;Torre Pavona;Castel Mirto;Rocca Sambuca;Acquachiara Alta;Pieve d'Ombra;Val Tenebra;Ponte Salice;Vimercate;Pieve Alta".split(";")
_TRADES = "Impresa Edile;Farmacia;Studio Tributario Associato;Officine Meccaniche;Caseificio Sociale;Cooperativa Agricola;Immobiliare;Autotrasporti;Azienda Vinicola;Laboratorio Analisi;Comune di;Tribunale di;Consorzio di Bonifica;Istituto Comprensivo;Camera Arbitrale di;Unione dei Comuni".split(";")


class Filler:
    """Invented values for the slots, from one seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def surname(self) -> str:
        r = self.r
        return r.choice(_HEADS) + (r.choice(_MIDS) if r.random() < 0.85 else "") + r.choice(_TAILS)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def person(self) -> str:
        r = self.r
        g, s = r.choice(GIVEN).title(), self.surname()
        return r.choices([f"{g} {s}", f"{s} {g}", f"{g[0]}. {s}", f"{g} {s.upper()}", f"{g} {s}".lower(), f"{s} {g}".upper(), f"{g} {s}".upper(), f"{s}, {g}", f"{s} {g[0]}."], [50, 14, 10, 7, 6, 6, 3, 2, 2])[0]

    def email(self) -> str:
        r = self.r
        g, s = r.choice(GIVEN), self.surname().lower()
        local = r.choice([f"{g}.{s}", f"{g[0]}.{s}", f"{s}{self.digits(2)}", f"{g}_{s}", f"{s}.{g}+pec", f"{g}-{s}", f"{g[0]}{s}", f"posta{self.digits(1)}"])
        host = r.choice(["pec", "mail", "studio", "rete", "legal", "", ""]) + "." + r.choice(["civetta", "corriera", "fermoposta", "arcolai", "ombrosa", "posta-lume", "cassetta-blu"]) + "." + r.choice(["example", "test", "it"])
        host = host.strip(".")
        kind = r.random()
        if kind < 0.62:
            return f"{local}@{host}"
        if kind < 0.68:
            return f"{local}@{host}".upper()
        if kind < 0.74:
            return f"{local}(at){host}"
        if kind < 0.84:
            return f"{local} [at] {host}"
        return f"{local} chiocciola {host.replace('.', ' punto ')}"

    def phone(self) -> str:
        d, r = self.digits, self.r
        body = r.choice([lambda: f"3{d(2)} {d(7)}", lambda: f"3{d(9)}", lambda: f"3{d(2)}/{d(7)}", lambda: f"3{d(2)}.{d(3)}.{d(2)}.{d(2)}", lambda: f"0{d(1)} {d(7)}", lambda: f"0{d(2)} {d(7)}", lambda: f"(0{d(2)}) {d(3)} {d(4)}", lambda: f"0{d(3)}-{d(7)}", lambda: f"3{d(2)} {d(3)} {d(4)}", lambda: f"0{d(1)}/{d(7)}", lambda: f"3{d(2)}-{d(7)}"])()
        if body[0] != "(" and r.random() < 0.4:
            body = r.choice(["+39 ", "0039 ", "+39", "+49 "]) + body.replace("/", " ")
        return body if r.random() > 0.08 else f"+44 7700 {d(6)}"

    def tax_code(self) -> str:
        r = self.r
        letters = lambda n: "".join(r.choice("BCDFGLMNPRSTVZ") for _ in range(n))
        code = f"{letters(6)}{self.digits(2)}{r.choice('ABCDEHLMPRST')}{self.digits(2)}Y{self.digits(3)}{letters(1)}"
        kind = r.random()
        return code.lower() if kind < 0.12 else f"{code[:3]} {code[3:6]} {code[6:11]} {code[11:]}" if kind < 0.24 else code

    def document(self) -> str:
        r = self.r
        two = lambda: "".join(r.choice("ABCXYZ") for _ in range(2))
        return r.choice([lambda: f"C{r.choice('ABXYZ')}{self.digits(5)}{two()}", lambda: f"A{r.choice('XYZ')} {self.digits(7)}", lambda: f"{two()}{self.digits(7)}", lambda: f"Y{r.choice('ABCD')}{self.digits(7)}"])()

    def address(self) -> str:
        r = self.r
        number = str(r.randint(1, 199)) + r.choice(["", "", "", "/A", "/B", "/C", "bis", " bis", "/bis"])
        if r.random() < 0.25:
            return f"{r.choice(_GERMAN)} {number}"
        road, place = r.choice(_ROADS), r.choice(_PLACES)
        return f"{road} {place.upper() if road.isupper() else place}{r.choice([' ', ', ', ', n. ', ' n. '])}{number}"

    def organisation(self) -> str:
        r = self.r
        return f"{r.choice(_TRADES)} {self.surname()}" + r.choice(["", " S.r.l.", " S.p.A.", " S.n.c.", " S.a.s."])

    def slot(self, name: str) -> str:
        r, d = self.r, self.digits
        sep = r.choice(["_", " ", "-"])
        two = [r.choice(GIVEN).title(), self.surname()]
        r.shuffle(two)
        return {
            "P": lambda: f"[name|{self.person()}]", "P1": lambda: f"[name|{' '.join(two)}]", "PI": lambda: f"[name|{r.choice(GIVEN)[0].upper()}. {self.surname()}]", "FN": lambda: f"[name|{sep.join(two)}]", "L": lambda: f"[name|{self.surname()}]", "G": lambda: f"[name|{r.choice(GIVEN).title()}]",
            "E": lambda: f"[email|{self.email()}]", "T": lambda: f"[phone|{self.phone()}]", "C": lambda: f"[id_number|{self.tax_code()}]", "D": lambda: f"[id_number|{self.document()}]", "A": lambda: f"[address|{self.address()}]",
            "T10": lambda: f"[phone|3{d(9)}]", "O": self.organisation, "W": lambda: r.choice(_TOWNS), "N": lambda: str(r.randint(1, 99999)), "N10": lambda: "30" + d(8), "V": lambda: "0" + d(10), "M": lambda: r.choice([f"€ {d(2)},{d(2)}", f"EUR 1.{d(3)},{d(2)}", f"{d(3)},{d(2)} €", f"euro {d(2)}.{d(3)},{d(2)}"]),
            "X": lambda: r.choice([f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/202{r.randint(3, 6)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.202{r.randint(3, 6)}", f"{r.randint(1, 28)} {r.choice(['marzo', 'ottobre', 'maggio', 'dicembre', 'aprile', 'giugno'])} 202{r.randint(3, 6)}"]),
            "J": lambda: r.choice([f"{d(7)}/202{r.randint(3, 6)}", f"202{r.randint(3, 6)}-{d(5)}", f"30{d(8)}"]), "K": lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(10)), "B": lambda: f"{''.join(r.choice('RHGTM') for _ in range(6))}-{d(4)}-{r.choice('XYZ')}",
            "H": lambda: r.choice(["pec.civetta.example", "rete.ombrosa.test", "cassetta-blu.example", "studio.arcolai.it"]), "I": lambda: r.choice([f"opec{d(6)}.{d(8)}@gestore-nuvola.example", f"{d(3)}a{d(2)}e.{d(9)}@certimare.example"]),
        }[name]()


def sentences(copies: int = 12, seed: int = 11, rows: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, mentions) of the filled rows; a mention is (kind, start, end), end exclusive, from 0."""
    fill, out = Filler(seed), []
    for k in range(copies):
        for row in ROWS if rows is None else rows:
            row = row.replace(" / ", "\n")
            row = _SURNAME_AS_PART.sub(lambda m: m.group(1) + " " + fill.surname(), row)
            row = re.sub(r"\{(\w+)\}", lambda m: fill.slot(m.group(1)), row)
            text, mentions, at = [], [], 0
            for part in re.split(r"(\[(?:name|email|phone|id_number|address)\|(?:[^\[\]]|\[at\])*\])", row):
                if m := re.match(r"\[(name|email|phone|id_number|address)\|(.*)\]$", part, re.S):
                    mentions.append((m.group(1), at, at + len(m.group(2))))
                    part = m.group(2)
                text.append(part)
                at += len(part)
            out.append(("".join(text), mentions))
    return out
