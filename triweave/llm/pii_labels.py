"""The small labelled table that the personal-data field is trained on; ``[kind:text]`` marks a span."""

EXAMPLES = """
call me at [phone:555-123-4567] after six
my number is [phone:(020) 7946-0958] if you need it
tel. [phone:030 1234567] fax [phone:030 1234568]
phone [phone:(415) 555-2671] or mail [email:ann.lee@example.org] today
reach us under [phone:0171 555 0199] from nine to five
dial [phone:1-800-555-0142] for help
his mobile [phone:07700 900123] was off
tel [phone:+49 30 901820] or [phone:+1 (212) 555-0187] at night
ring [phone:(312) 555-0110] , ask for Tom
new phone [phone:555.867.5309] works
telephone: [phone:(0)20 7946 0018]
mobile: [phone:06 12 34 56 78] please
contact [phone:555-0147-221] now
write to [email:john.smith@mail.example.com] soon
mail [email:x_y@example.net] and [email:info@shop.example.de] please
her address is [email:maria+news@example.es] I think
send it to [email:bob@localhost] on the intranet
user [email:root@server1] logged in
pay with card [card:4111 1111 1111 1111] before May
card number [card:5500-0000-0000-0004] expires soon
visa [card:4012888888881881] was charged
charged to [card:3782 822463 10005] yesterday
the card [card:6011.1111.1111.1117] is blocked
server [ip:192.168.0.1] is down
ping [ip:10.0.0.254] failed twice
from [ip:8.8.8.8] to [ip:172.16.4.20] in 12 ms
host [ip:10.1.2.3:8080] refused the connection
route via [ip:192.168.1.0/24] today
in 2019 the town had 12,500 people
chapter 3 section 4.2 page 117
version 1.2.3 was released on 2021-04-05
license, version 2.0 of january 2004
the price rose from 19.99 to 24.50 in 1998
it happened on 12/05/2020 at 10:45
invoice 20230145 dated 2023-11-02 total 1.250,00
isbn 978-3-16-148410-0 second edition
room 101 floor 2 building 7
population 3456789 in 2001
sum 12345678 plus 87654321
the ratio 3.14159 and 2.71828
between 10:00 and 11:30 on 4 July 1976
score 3-2 after 120 minutes
pages 12-19 and 45-67
years 1914-1918 and 1939-1945
iso 8601 and rfc 2822 apply
id 550e8400-e29b-41d4-a716-446655440000 was used
section 1.2.3.4.5 of the manual
100,000 km in 24 h at 60 hz
cc by-nc 4.0 and gpl version 3
serial 00012345 model 7
follow @anna and @team99 for news
3 @ 4 dollars each
see http://example.com/a/825?page=2 for more
zip 90210 and 10115 are codes
x86 and i386 and h264
temperature -12.5 to +30 degrees
gain of +5 or +12 points
1 2 3 4 5 6 7 8 9 10
10 20 30 40 50 60
7 of 9 and 12 of 15
order 4120077130028854 shipped
the number 3300912845560017 came up
invoice no 2023 001 4567 is paid
invoice 2022 000 0981 and invoice 2021 112 3345
bill number 2020 445 1278 from march
part no 5500-2231-9087 is in stock
part 7100-3345-2210 replaces part 7100-3345-2209
article 300-4521-889 sold out
item no. 220-118-4407 weighs 3 kg
serial no 5521-3398-1102 under the lid
order number 100-200-3000 was shipped
our reference 8831-220-145 your reference 77-1290-331
case 12-345-678 was closed in 2019
contract 2018-330-4411 ends on 2024-12-31
account 555-120-9981 holds 300 shares
batch 0912-4455-6721 expired
model 300-400-5000 needs 220 volts
ticket 404-221-9087 is open
policy no 440 221 9917 covers 2 cars
tracking 9400 1000 0000 1234 left the depot
page 123-456-7890 does not exist
call [phone:312-555-0142] or [phone:312 555 0143] today
phone number [phone:(718) 555-0123]
my cell is [phone:646-555-0177] , text me
please phone [phone:020 7946 0321] before noon
mobile [phone:0151 2345 6789] or office [phone:030 2345 678]
téléphone [phone:01 45 67 89 10] le matin
tel [phone:91 555 01 23] por la tarde
Telefon [phone:089 555 0192] ab neun Uhr
ring me on [phone:07700 900456] tonight
fax: [phone:(503) 555-0166]
token = "[secret:3f1c9ab27de04581c6e2f7a90b4d8e135a77c2d9]" was found
token = "[secret:b7e23ec29af22b0b4e41da31e868d57226121c84]" and more
Token: [secret:8d969eef6ecad3c29a3a629280e686cf0c3f5d5a] was leaked
api_key = "[secret:Zx9Qk2Lm7Pw4Rt8Vb3Nc6Yd1]" in the file
api key: [secret:AK7F3J9Q2LX8MZ4PD6WT] was posted
export SECRET_KEY=[secret:q8Wm2Zr5Tn9Xc4Vb7Lk3Hj6] please
secret = '[secret:9c56cc51b374c3ba189210d5b6d4bf57790d351c]' here
client_secret: [secret:Gt5Rv8Kp2Nx7Bq4Mz9Ws3Jd6] removed
access token [secret:ghx_7Kd92LmQ4vT8sXw3RbN6yZp1] expired
password = [secret:Tr0ub4dor77xKq29Lm] changed
Authorization: Bearer [secret:eyJ4bGc1OiJIUzI1N9.kQ3mZ8xW2v] sent
aws_secret = "[secret:wJ4rXUtn7EMI3K7MDENG9bPxRfi2CY]" found
the key [secret:sk_test_4bK9vLm2QxZ7tRw8Yn3P] was revoked
commit 5d41402abc4b2a76b9719d911017c592 fixed it
commit 7c211433f02071597741e6ff5a8ea34789abbf43 by Tom
checksum e59ff97941044f85df5297e1c302d260 of the file
sha1 da4b9237bacccdf19c0760cab7aec4a8359010b0 matches
digest 356a192b7913b04c54574d18c28d46e6395428ab agrees
revision 77de68daecd823babbb58edb1c8e14d7106e83bb of the page
file 1b6453892473a467d07372d45eb05abc2031647a.bin is large
the ship HMS2244X sailed in 1807
""".strip().splitlines()
