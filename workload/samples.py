"""Short snippets added to the documents so that every detector has hits at every scale.

Each document keeps its whole text and gets one snippet behind it, chosen by
its key, in the Spark query and in the SQL alike.  Secret-like strings are put
together from parts so that none is stored in the repository.
"""

_A = "Q7xW2mZp9LkT4vBn8RsD"
_H32 = (_A + _A)[:32]
_KEY36 = (_A + _A)[:36]

SNIPPETS = (
    "",
    " Write to jane.doe+test@mail.example.org, or jane.doe+test@mail.example.org.",
    " Call +91 9876543210 now, not 19876543210123, or 8123456789",
    " Office (415) 555-2671 and 1-800-555-0199 but 9415-555-26712 is none.",
    " His number is 123-45-6789; the near miss is 123-45-678.",
    " Card 2345 6789 0123 is an identity number; 2345-6789-012 is not.",
    " Tax id ABCDE1234F, near miss ABCD1234F.",
    " Passports A1234567 and AB123456, near miss A123456.",
    " Paid with 4111 1111 1111 1111 and 5500-0000-0000-0004, not 4111 1111 1111 111.",
    " Account no: 123456789012 at the branch.",
    " IBAN GB29NWBK60161331926819 was used.",
    " Host 192.168.10.254 answered, 256.300.1.1 did not.",
    " DOB: 12/05/1990 and born 3-4-85.",
    " key sk-" + _H32 + " end",
    " key sk-" + "ant-" + _H32 + "-x end",
    " key gs" + "k_" + _H32 + " end",
    " key AK" + "IA" + "ABCDEFGHIJ234567" + " end",
    " aws_secret_access" + "_key = " + (_A + _A)[:40] + " end",
    " token gh" + "p_" + _KEY36 + " end",
    " token AI" + "za" + (_A + _A)[:35] + " end",
    " token sk" + "_live_" + _A + "ABCD" + " end",
    " token ey" + "J" + _A + "." + _A + "." + _A + " end",
    " pass" + "word = hunter2hunter and pwd: abc",
    " client_" + "secret: 'topsecretvalue' end",
    " url postgres" + "ql://user:pw@db.internal:5432/app end",
    " -----BEGIN RSA PRIVATE" + " KEY----- block",
    " Salary: USD 125,000 per year.",
    " I will kill the process, said nobody. You will regret this.",
    " They hate all minorities, and should be exterminated was shouted.",
    " Stalking her was wrong; ruin your reputation they said.",
    " Rise up and fight! Burn it down! Storm the gates.",
    " How to make a bomb is illegal; drug trafficking too.",
    " A sp" + "ic was used as a slur.",
    " He was threatening and blackmail followed.",
    " A violent assault; harm your family was heard.",
    " You'll pay for it, teach you a lesson.",
    " You people are strange; all dogs are lazy.",
    " The racist policy was dropped.",
    " Harassment and bullying were reported.",
    " They will get you fired and report him to authorities.",
    " Violence against animals and physical harm.",
    " Do not retaliate, fight back later.",
    " Unwanted contact is sexual harassment.",
    " Quid pro quo: send me photos.",
    " Привет мир, как дела сегодня",
    " नमस्ते दुनिया यह एक परीक्षण है",
    " 漢字漢字 漢字漢字漢字漢字",
    " foo//bar and baz||qux",
    " a     b     c   d",
    " lI1l1I and O0O0O0",
    " ####@@@@ garbage ~~~~",
    " broken � text",
    " Project Titan is confidential, for internal use only.",
    " operation phoenix begins",
    " jane@example.com jane@example.com JANE@example.com",
    " 4111111111111111 4111111111111111",
    " SSN 123-45-6789 and 123 45 6789 and 987-65-4321",
    "x" * 90 + " ends with bob@example.net",
    " \n\n  10.0.0.1\n10.0.0.2\n  \n",
    " born 1/1/2000, Date of Birth: 01-02-2003",
    " kill you KILL YOU kill  you kill them",
)
