"""Labelled lines that the personal-data field is not trained on; ``[kind:text]`` marks a span."""

HELD_OUT = """
you can call [phone:212-555-0199] until eight
their number is [phone:(617) 555-0144] I believe
mobile [phone:07911 123456] is off at night
tel. [phone:040 765 4321] and fax [phone:040 765 4322]
phone [phone:303.555.0118] for details
dial [phone:1-888-555-0101] now
contact us at [phone:(0)30 555 0177] please
ring [phone:0161 496 0123] and ask for Eve
telephone [phone:503-555-0125] or write
llame al tel [phone:93 555 04 56] hoy
Telefon: [phone:0221 555 0133] nach sechs
my phone is [phone:415 555 0190] thanks
token = "[secret:6dcd4ce23d88e2ee9568ba546c007c63d9131c1b]" in the log
token = "[secret:1f40fc92da241694750979ee6cf582f2d5d7d28e]" over there
api_key: [secret:Qm7Xr2Kt9Wz4Lp8Vn3Bc] was printed
secret_key = "[secret:Hd8Lq3Zt6Mw1Xv9Rk4Np7Yb2]" please remove
password: [secret:x9Km2Qz7Lt4Vb] again
access token [secret:ghx_2Wq8Zt5Lm9Kr4Vb7Nx3Pd] was sent
server [ip:10.22.0.7] answered
the card [card:5555 5555 5555 4444] was declined
pay by visa [card:4000-0566-5566-5556] now
send mail to [email:eve@intranet] and wait
root login [email:admin@server2] failed
invoice 2024 000 1234 was sent
part no 4000-1234-5678 is missing
invoice number 2019 221 0087 is due
article 410-2209-117 came back
order 200-3344-129 left in 2020
serial number 8890-1123-4456 is worn off
reference 5512-887-230 please
commit a3f5c1d2e4b6978812345678abcdefabcdef1234 broke it
sha256 of 9e107d9d372bb6826bd81d3542a419d6 differs
batch 1102-3345-9087 was sold
ticket 331-204-5567 waits
from 1939 to 1945 and 12 to 14
version 3.11.4 of 2023-06-06
price 1.299,00 or 1,299.00 in 2010
isbn 978-1-4028-9462-6 first edition
chapter 12 section 3.4 page 220
room 42 floor 3 at 10:15
population 1234567 in 1998
the code 90210 and model x200
contract 2020-114-7788 was signed
id 123e4567-e89b-12d3-a456-426614174000 is used
"""
