"""Texts labelled by hand. SEED ones are always trained on, so that a corpus of any size gives a classifier; CHECKED ones were drawn
from a corpus by a hash of their ids, read and labelled, and are kept out of training: half of them calibrate its probabilities, the
other half measure them."""

SEED_PROSE = [
    "The boiler stopped twice on Tuesday, so I asked Nola to call the engineer before the weekend.",
    "we looked at the ledger again and it seems that two pages were never signed which is why nobody could close the account",
    "THE OFFICE WILL BE CLOSED ON FRIDAY. IF YOU NEED A KEY, PLEASE ASK MERRICK BEFORE NOON.",
    "Wir haben gestern lange über den Vertrag gesprochen, aber am Ende war niemand sicher, ob er noch gilt.",
    "Je ne sais pas encore si le rapport sera prêt lundi, mais nous avons déjà relu les deux premières parties.",
    "No sabemos quién abrió la puerta, pero la alarma se apagó antes de que llegara el guardia.",
    "When the job was resumed it skipped everything that had been written before, and the report said so in its last line.\n\n- folder\n- index",
    "Thank you for the lamp; it is exactly what we wanted. The old one had been broken for months.",
    "Every careful reader knows that a table of contents is not a summary, although many authors seem to forget it.",
    "Hi all,\n\nI will be late for the meeting because the train from the coast was cancelled. Please start without me.\n\nRegards\nPetra",
    "Hallo Ulric,\n\nkannst du mir bitte sagen, wann der Schlüssel zurückkommt? Ohne ihn können wir den Keller nicht öffnen.\n\nViele Grüße\nGreta",
    "She asked me three questions: who had the list, when it was printed, and why the second copy was blue.",
]

SEED_JUNK = [
    "- stapler\n- two boxes of paper\n- the blue folder\n- toner\n- labels for Nola",
    "| id | name | state |\n| 12 | boiler | ok |\n| 13 | pump | n/a |\n| 14 | valve | ok |",
    "2025-03-01 08:00:01 INFO worker started\n2025-03-01 08:00:02 INFO unit 12 opened\n2025-03-01 08:00:09 WARN unit 12 slow\n2025-03-01 08:01:44 ERROR unit 12 lost",
    "{\"id\": 1, \"kind\": \"folder\", \"ok\": true}\n{\"id\": 2, \"kind\": \"message\", \"ok\": false}\n{\"id\": 3, \"kind\": \"folder\", \"ok\": true}",
    "00000000  25 50 44 46 2d 31 2e 34  0a 25 c3 a4 c3 bc c3 b6  |%PDF-1.4.%......|\n00000010  0a 32 20 30 20 6f 62 6a  0a 3c 3c 2f 4c 65 6e 67  |.2 0 obj.<</Leng|",
    "pump pump pump pump pump pump pump pump pump pump pump pump pump pump pump pump",
    "xkq bvtr wpoi zzun\nqrtl mmvx oopw kkzj vbn\nplk jhgf dsaq wert yuiz",
    "BEGIN:VCARD\nFN:Petra Kiel\nTEL:+4912345\nEMAIL:petra@mail.example\nEND:VCARD",
    "old lamp\ntwo chairs\nthe key of the cellar\nsome folders\ngreen paper",
    "├── Inbox (12)\n│   ├── 2019 (3)\n│   └── 2020 (9)\n└── Sent (44)",
    "1. invoice\n2. receipt\n3) order form\n4) price list\n5. packing slip",
    "Home > Archive > 2019\nPrint | Save | Close\nNext >>\nPage 4\nUnsubscribe\nView in browser",
    "!%$ **** ~~~~ ^^^^ ####\n$$$$ %%%% &&&& ((((\n==== ++++ ---- ////",
    "  at store::open_block (block.rs:120)\n  at store::read_page (page.rs:88)\n  at main::run (main.rs:17)",
]

CHECKED_PROSE = [
    "Si falta el mensaje, hay que pedir a Ulric que lo pueda encontrar.\n¿Puedes guardar el buzón antes de la reunión con Merrick?\nEl cajón y el índice se quedan con Imogen durante 79 días.",
    "Hi all,\n\nThe source file is steady but readable (see /srv/mail_59): and his meeting notes could be saved without loss. As soon as the 455-C checklist part is finished (see /srv/mail_75): I will send Alden the list of what was left out.",
    "i still think that edda should have scanned the lease twice",
    "Dear Sorrel,\n\nWould it help if I corrected the 787-X checklist for you and left her handwritten remarks as they are? It is not easy to say whether the 648-B pallet or the licence was opened first.\n\nBest wishes\nKester",
    "El pedido y el calendario se quedan con Hollis durante 16 días.\n¿Puedes copiar el correo antes de la reunión con Alden?\nEl cajón y el borrador se quedan con Ulric durante 29 días.\nSi falta el proyecto, hay que pedir a Jarvis que lo pueda imprimir.",
    "J'ai lu 49 pages, mais le brouillon était trop petit pour moi. Nous avons parlé du jardin et du bureau pendant 52 minutes. Nous avons parlé du serveur et du serveur pendant 14 minutes.",
    "Hi all,\r\n\r\nThe report that you asked for is loud, so I moved the canteen menus instead. I still think that Corwin should have postponed the invoice today.\r\n\r\nThanks, Tamsin",
    "thank you for the useful survey it was just what wystan wanted\n\nBest wishes\nWystan",
    "Hello Wystan,\n\nThere is no reason to worry about the garden, as it\nwas only archived by mistake.\n\nRegards\nWystan",
    "For the next 95 days the notebook will stay with Imogen, who has found it before. You can use my archive until yours has been corrected. They said it would be empty, and yet the meeting was confirmed after lunch without any trouble.",
    "Orrin hat gesagt, dass wir den Antrag erst nächste Woche finden sollen. Es\nist nicht klar, warum der Beleg so grünen war und wer ihn prüfen wollte.",
    "  We do not know yet why the 433-X password folder shows 93 items while the archive only holds a part of them. It seems that the 905-B export was deleted before the mailbox was sorted (see /srv/mail_3): which is why it has no parent.\n\nRegards\nDelphine   \n\n",
    "Hallo Nola,\n\nEs ist nicht klar, warum der Zettel so späten war und wer ihn finden wollte. Wystan hat gesagt, dass wir den Antrag erst vor dem Mittag zählen sollen. Wir treffen uns nächste Woche bei Imogen und sprechen über den kaputten Vertrag.\n\nViele Grüße\nEdda",
    "Do not worry if the forklift is not signed at nine, since there is another one in the drawing. I have found the import and the quota, but the archive labels are still on the steady timetable.",
    "Dear Hollis,\n\nI have run the recovery again at the end of the quarter and it found 53 more items than before.\nFor this customer the split was made with 7 parts, because the draft is quiet.\nIt seems that the window was deleted before the mailbox was merged, which is why it has no parent.\n\nBest wishes\nFenton",
    "The calendar of Yara came back small, although the spare\nparts had to be moved by hand. Fenton reports that the\nharbour folder was missing after the import and that\nseveral empty items had been corrected twice. It seems\nthat the ticket was deleted before the mailbox was\nscanned, which is why it has no parent.",
    "Bonjour Wystan,\n\nEst-ce que vous pouvez compter le tableau avant la réunion de Corwin ? Le dossier reste chez Nola et personne ne peut le compter.\n\nCordialement\nVerity",
    "I am sorry that the export took so long, but his meeting notes had to be merged alone. He wrote that the projector could be cancelled in less than 16 minutes.",
    "Hello Nola,\n\nNothing was written to the 271-X source (see /srv/mail_88): and the report from Jarvis says the same about the roster. The scan of this mailbox stopped at folder 21 (see /srv/mail_29): so the 349-B canteen menus were restored from the copy instead. As soon as the 457-X conveyor part is finished (see /srv/mail_7): I will send Ulric the list of what was left out.\n\nRegards\nVerity",
    "The cost of the contract is about 79 pounds, which seems heavy to me. As far as I know, the travel costs were corrected tomorrow and then put under the thin catalogue.",
    "You can use my signature until yours has been checked. From now on, the meter readings should go to the statement and not to the local mailbox.\n\nRecipient             6465      3943     ",
    "Hello Imogen,\n\nThe calendar of Corwin came back urgent, although the spare parts had to be deleted by hand.\nI have run the recovery again between the meetings and it found 63 more items than before.\nThe source file is empty but readable, and missing attachments could be saved without loss.\n\n################################\n\nBest wishes\nTamsin",
    "The calendar of Orrin came back thin, although the parking\npermits had to be translated by hand. The source file is\nstrange but readable, and the archive labels could be saved\nwithout loss.\n\n  at delivery::packed_corridor (pump.rs:188)",
    "BEGIN:VCARD\nFN:Ulric Cabinet\nTEL:+68452659\nEMAIL:u493@quillstone.test\nEND:VCARD\n\nWhat we really want is a partial turbine that does not\nget merged every time. There is no reason to worry about\nthe budget, as it was only cleaned by mistake. Please\nsend me the honest server this morning, because Sorrel\nhas not corrected it yet.",
    "agenda for Ulric agenda for Ulric agenda for Ulric\n\nWe do not know yet why the mailbox folder shows 19 items while the archive only holds a part of them. I have run the recovery again on the second try and it found 74 more items than before.",
    "> Please run the check once more before you import the local part\n> for Tamsin. For this customer the split was made with 86 parts,\n> because the folder is patient.\n\nｌａｔｅ ｐｒｏｊｅｃｔｏｒ． Ｅａｃｈ ｐａｒｔ ｆｉｌｅ ｔａｋｅｓ ５６ ｌｏｃａｌ ｉｔｅｍｓ ｕｎｔｉｌ ｔｈｅ ｏｒｃｈａｒｄ ｏｆ Ｗｙｓｔａｎ",
    "^^^^?#}?!*<%\n\nYou can use my harbour until yours has been reviewed. Most of us\nwould like a partial label more than another report.",
    "Last time it took Yara almost 33 hours to get the calendar deleted. Last time it took Petra almost 95 hours to get the password scanned. The cost of the barcode is about 93 pounds, which seems quiet to me... We have been trying to reach Orrin about the final turbine, but without luck...\n\n• import,\n• the canteen menus,\n• the travel costs,\n• the safety sheets,\n• 65 x boiler,\n• both warranty cards,",
    "* statement for Merrick\n\nLe rapport reste chez Petra et personne ne peut le imprimer. Imogen nous a dit qu'il faudrait ranger le calendrier avant midi. Ulric nous a dit qu'il faudrait vérifier le reçu avant midi.",
    "Hi all,\n\nIf you can find the 485-C useful conveyor (see /srv/mail_10): could you leave it next to the invoice certainly? It is not easy to say whether the 777-X kitchen or the index was cleaned first. Neither of us could remember who had copied two damaged folders by the 892-C end of March.\n\nBEGIN:VCARD\nFN:Edda Timetable\nTEL:+59218408\nEMAIL:u308@harrowmere.example\nEND:VCARD\n\nBest wishes\nDelphine",
]

CHECKED_JUNK = [
    "BEGIN:VCARD\nFN:Greta Invoice\nTEL:+57280796\nEMAIL:u48@tarnfield.test\nEND:VCARD\nBEGIN:VCARD\nFN:Imogen Orchard\nTEL:+9555673\nEMAIL:u37@fenwick-marine.example\nEND:VCARD\nBEGIN:VCARD\nFN:Ulric Ledger\nTEL:+48964687\nEMAIL:u266@fenwick-marine.example\nEND:VCARD\nBEGIN:VCARD\nFN:Jarvis Harbour\nTEL:+51428562\nEMAIL:u207@tarnfield.test\nEND:VCARD",
    "* recipient\n* 65 x letter\n* two damaged folders\n* garden for Merrick\n* the meeting of the turbine\n* the safety sheets\n* our monthly numbers\n* the vendor of the summary\n* strange refund\n* warehouse for Briar\n* report\n* 27 x forklift",
    "2025-07-25T02:16:47Z INFO unit=232917 kind=normal bytes=750879 err=0x5d7ac89e\n2025-06-23T09:54:33Z WARN unit=232918 kind=normal bytes=454296 err=0x4917ee9f\n2025-09-19T09:17:34Z WARN unit=232919 kind=normal bytes=502307 err=0x9d190753\n2025-06-27T00:38:26Z DEBUG unit=232920 kind=recovered bytes=273505 err=0x49017ba0\n2025-05-20T02:18:50Z DEBUG unit=232921 kind=normal bytes=448895 err=0xd1599601",
    "garden, label, yellow projector, old messages, 11 x folder, 24 x message, simple quota, 59 x delivery, agenda for Wystan, garden, old messages, forklift for Petra, receipt, attachment, heavy proposal, the pump of the calendar",
    "BEGIN:VCARD\nFN:Hollis Manual\nTEL:+66748834\nEMAIL:u503@ostervale.test\nEND:VCARD\nBEGIN:VCARD\nFN:Ulric Attachment\nTEL:+61891671\nEMAIL:u593@brackenhall.example\nEND:VCARD\nBEGIN:VCARD\nFN:Hollis Turbine\nTEL:+61625791\nEMAIL:u58@quillstone.test\nEND:VCARD",
    "2025-09-22T07:48:15Z INFO unit=869804 kind=orphan bytes=567350 err=0x529b6792\n2025-09-11T03:50:37Z DEBUG unit=869805 kind=recovered bytes=661217 err=0xd4de0f5b\n2025-08-14T07:50:24Z WARN unit=869806 kind=recovered bytes=918874 err=0x93b22179\n2025-02-23T08:30:52Z WARN unit=869807 kind=recovered bytes=402207 err=0x30501d0f\n2025-08-16T09:59:17Z INFO unit=869808 kind=orphan bytes=677620 err=0x9d1bef64",
    "those delivery notes\nthe forklift of the deposit\nchecklist\nproposal for Linnet\ntimetable for Kester",
    "BEGIN:VCARD\nFN:Merrick Password\nTEL:+68354415\nEMAIL:u799@ostervale.test\nEND:VCARD\nBEGIN:VCARD\nFN:Delphine Calendar\nTEL:+84308658\nEMAIL:u893@brackenhall.example\nEND:VCARD\nBEGIN:VCARD\nFN:Verity Recipient\nTEL:+86411690\nEMAIL:u366@fenwick-marine.example\nEND:VCARD\nBEGIN:VCARD\nFN:Ulric Delivery\nTEL:+47841906\nEMAIL:u470@brackenhall.example\nEND:VCARD",
    "            +  Notes (467)\n            ├── Verträge (252)\n        + 2024 (544)\n├── Backups (104)",
    "To: 35 x receipt\nClass: the winter tyres\nClass: permit for Kester\nSize: kitchen for Hollis\nFrom: label\nStatus: late delivery\nSize: letter for Petra\nPhone: workshop for Kester\nDue: cabinet for Ulric\nDue: thread",
    "BEGIN:VCARD\nFN:Nola Message\nTEL:+9416579\nEMAIL:u192@pemberlock.test\nEND:VCARD\nBEGIN:VCARD\nFN:Tamsin Workshop\nTEL:+76619006\nEMAIL:u575@fenwick-marine.example\nEND:VCARD",
    "Harbour               7941      2831   ok\nDrawing               2490       226     \nDraft                 8666      1073    *\nQuota                 1719      5872     \nWorkshop              1287      1795    *",
    "#####################################################################\n#####################################################################\n########################################################\n###############################\n@}~}}~#\n############################################\n>#}~^%^}~&$^$^{*$#^}",
    "| 17 | 78 | 49 | 87 | export | n/a |\n| 92 |  | 21 | thread | 42 | 82 |\n| n/a |  | 58 |  | survey | n/a |\n| 43 | meeting | drawing | 83 | 72 | n/a |\n| n/a | n/a | 83 | policy |  | archive |\n| inventory | drawing | 44 | n/a | n/a | n/a |\n| n/a | n/a | n/a | 86 |  | n/a |\n| n/a |  |  | garden |  | n/a |",
    "- strange claim,\n- the calendar of the summary,\n- the canteen menus,\n- 84 x message,",
    "He leído 3 páginas, pero el informe estaba muy nuevo.\n\n65367,Edda,bearing,893.60\n32703,Petra,receipt,654.56\n66180,Linnet,letter,261.78\n32882,Petra,password,404.00\n18818,Verity,agenda,409.43\n94710,Fenton,payment,650.20\n26661,Yara,scanner,168.96\n30765,Briar,quota,733.21\n8721,Alden,invoice,835.77\n7427,Briar,proposal,56.50\n1747,Edda,vendor,835.07",
    "The cost of the mailbox is about 4 pounds, which seems complete to me.\n\nBEGIN:VCARD\nFN:Petra Licence\nTEL:+99087230\nEMAIL:u95@pemberlock.test\nEND:VCARD\nBEGIN:VCARD\nFN:Delphine Budget\nTEL:+30314830\nEMAIL:u85@pemberlock.test\nEND:VCARD\nBEGIN:VCARD\nFN:Delphine Workshop\nTEL:+54800646\nEMAIL:u587@lumenforge.example\nEND:VCARD\nBEGIN:VCARD\nFN:Linnet Draft\nTEL:+83742705\nEMAIL:u30@harrowmere.example\nEND:VCARD",
    "It is not easy to say whether the folder or the cabinet was signed first.\n\n\tattachment.\n\tthe spare parts.\n\tthe floor plans.\n\tclean signature.\n\tthe agenda of the forklift.\n\tthin router.\n\t9 x manual.\n\tlabel.\n\tthe attachment of the kitchen.\n\tthe router of the projector.",
    "He wrote that the corridor could be returned in less than 56 minutes.\n\n• the password of the thread\n• harbour for Fenton\n• the subscription of the barcode\n• 84 x checklist\n• complete inventory\n• the office keys\n• recent folder\n• delivery for Yara\n• the floor plans\n• his meeting notes\n• summary for Merrick\n• 80 x shipment\n• boiler for Briar\n• empty budget",
    "Last time it took Nola almost 36 hours to get the roster signed.\n\n===============================================================\n================================\n========================================\n=======================================================\n===========================================",
    "It is not easy to say whether the vendor or the disk was archived first.\n\npublic printer,\nthe refund of the subscription,\ncareful thread,\nthe calendar entries,\nuseful corridor,\nthe notebook of the scanner,\npassword for Tamsin,\nnarrow licence,\n74 x label,\ncabinet for Hollis,\nprivate notebook,\n98 x calendar,\n2 x timetable,\nlabel,",
    "There is no reason to worry about the export, as it was only measured by mistake.\r\n\r\n• their opening hours;\n• the archive labels;\n• narrow meeting;\n• contract;\n• the canteen menus;\n• large receipt;\n• three test runs;\n• 97 x orchard;\n• harbour for Delphine;\n• 82 x subscription;\n• conveyor for Ulric;\n• mailbox for Wystan;\n• recent budget;\n• the travel costs;",
    "Vielen Dank für den Antrag, er ist sehr grünen geworden.\n\nView in browser\nReply | Forward | Delete\nPage 72\nPrint | Save | Close\nView in browser\nReply | Forward | Delete\nHome > Archive > Folder",
    "In my view the narrow inventory is better than the one Sorrel repaired.\n\nto with have that with as in be for it\nthis at from the an at is to and at it as in\non from it with be this that as on the are of with\nthat from and be the at at from\nfor on of be on at are it to that have with on",
    "is or is is or in or with\nfrom for of be and of as have at have of from and\nwith have an the from in be\nat an of or for to that or an in an this as",
    "as of this the in an with it on\nare with on at on is is are for and the\nor as of that is be as\nare to at it with and this at to on at are for\nfor of at on is have\nof have of of for at",
    "the is be or with as or the to is or be\nor in in are this an is\nthis for this have from and be from have on from at\nin have with this it and are an\nto in that from and at an be and to for and\nor is have on be be as this on and as the or",
    "it to from as as as the are\nbe and an to are as for with be at\nthat and with and is as have this this\nit this of it in on from of of at from this for",
    "Would it help if I merged the pallet for you and left his meeting notes as they are?\n\nthis an in an with and this is in to and in the\nfrom on this to an be\nare in of the for are\nwith with on is with it have in\nthe an this the an on on is\non it from have have it on at are be this\nhave with be is in for is be have\nin have are with is be with from for as",
]
