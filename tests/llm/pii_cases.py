"""Hand-written texts with the personal data in them that the fixed patterns don't see: (text, [(kind, found)])."""

CASES: list[tuple[str, list[tuple[str, str]]]] = [
    ("tel 613 555 3280", [("phone", "613 555 3280")]),
    ("You can call me on 020 7946 0958 after six.", [("phone", "020 7946 0958")]),
    ("kontakt: 030/1234567", [("phone", "030/1234567")]),
    ("Sie erreichen uns unter Telefon 0711/9876543 oder per Post.", [("phone", "0711/9876543")]),
    ("Appelez le 01 42 68 53 00 pour toute question.", [("phone", "01 42 68 53 00")]),
    ("Téléphone: 06 12 34 56 78", [("phone", "06 12 34 56 78")]),
    ("llame al teléfono 912 345 678 por la tarde", [("phone", "912 345 678")]),
    ("Our office is open daily, phone (212) 555-0147.", [("phone", "(212) 555-0147")]),
    ("Her number was 415-555-2671 back then", [("phone", "415-555-2671")]),
    ("ring 415.555.2671 and ask for Maria", [("phone", "415.555.2671")]),
    ("fax: (030) 1234 5678", [("phone", "(030) 1234 5678")]),
    ("Mobile 0171-2345678, evenings only", [("phone", "0171-2345678")]),
    ("For help dial 0049 89 123456 from abroad.", [("phone", "0049 89 123456")]),
    ("(call 503-555-0199)", [("phone", "503-555-0199")]),
    ("Contact: 604-555-0133 or visit us", [("phone", "604-555-0133")]),
    ("two lines, 0161 496 0000 and 0161 496 0001", [("phone", "0161 496 0000"), ("phone", "0161 496 0001")]),
    ("joe at mail dot com", [("email", "joe at mail dot com")]),
    ("write to joe ( at ) mail ( dot ) com please", [("email", "joe ( at ) mail ( dot ) com")]),
    ("jane ( at ) mail ( dot ) org", [("email", "jane ( at ) mail ( dot ) org")]),
    ("My address is anna.schmidt (at) posteo.de, thanks", [("email", "anna.schmidt (at) posteo.de")]),
    ("mail: k_lopez [at] correo [dot] es", [("email", "k_lopez [at] correo [dot] es")]),
    ("send it to mary dot jones at example dot org today", [("email", "mary dot jones at example dot org")]),
    ("Questions? info {at} museum {dot} fr", [("email", "info {at} museum {dot} fr")]),
    ("contact peter99 AT webmail DOT net for details", [("email", "peter99 AT webmail DOT net")]),
    ("email sales [ at ] shop.com", [("email", "sales [ at ] shop.com")]),
    ("the server answers on 2001:db8:85a3::8a2e:370:7334 again", [("ip", "2001:db8:85a3::8a2e:370:7334")]),
    ("ping fe80::1ff:fe23:4567:890a now", [("ip", "fe80::1ff:fe23:4567:890a")]),
    ("dead:beef::cafe", [("ip", "dead:beef::cafe")]),
    ("It came from [2001:0db8:0000:0000:0000:ff00:0042:8329].", [("ip", "2001:0db8:0000:0000:0000:ff00:0042:8329")]),
    ("gateway 2001:DB8:0:1::1, mask unknown", [("ip", "2001:DB8:0:1::1")]),
    ("amex 378282246310005 expires soon", [("card", "378282246310005")]),
    ("he paid with 3782 822463 10005 in June", [("card", "3782 822463 10005")]),
    ("Diners card 30569309025904", [("card", "30569309025904")]),
    ("The number 371449635398431 is on the slip.", [("card", "371449635398431")]),
    ("Reach her on 07700 900123 or at the desk", [("phone", "07700 900123")]),
    ("my cell is 312 555 0188", [("phone", "312 555 0188")]),
    # nothing to find
    ("In 2019 the town had 12 345 inhabitants and 3 schools.", []),
    ("order 613 555 3280 was shipped on 2024-03-12", []),
    ("ISBN 978-3-16-148410-0, second edition", []),
    ("meet me at noon by the red dot on the map", []),
    ("She looked at a dot on the wall.", []),
    ("version 10.4.12 of the driver, build 20240", []),
    ("between 10:15:30 and 11:45:00", []),
    ("The ratio was 3:4:5, as he said", []),
    ("use std::vector::begin there", []),
    ("call the function twice with 3 arguments", []),
    ("12/10/2024 and 1/2/2023 were Thursdays", []),
    ("serial 4111-2222-3333 is out of stock", []),
    ("a sum of 1,234,567.89 dollars", []),
    ("The mail arrived at 9 in the morning, dot your letters", []),
    ("card 378282246310006 was refused", []),
    ("invoice 2024-0012345", []),
    ("token = \"04dbebab91ab85687d33eeaaf904dbebab91ab85\"", []),
    ("population 1 234 567 in 1990", []),
    ("MAC 00:1a:2b:3c:4d:5e of the printer", []),
    ("pages 112-118 and 240", []),
    ("448945250 on the shelf, 4736962573099 below", []),
    ("the years 1914 to 1918", []),
    ("at least (at most) ten", []),
    ("lot 55 12 90, room 214", []),
    ("Section 4.2.1.7 of the contract", []),
    ("He scored 21 points at home.", []),
    ("phone booth number 7", []),
    ("text me when the 45 leaves", []),
]
